"""Queries of the expression and sequence operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geodesy as G
from waymark.functions import labels as L
from waymark.operators import trips as T
from waymark.operators.scans import Ema, scanned
from waymark.plans.adapter import TELEMETRY, telemetry

QUERIES: dict = {}
ORACLES: dict = {}
COLUMNS = ("session_id", "seq")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {TELEMETRY}\n{sql}"
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: what a comparison across engines needs."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(F.col(c), places).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c) for c in df.columns))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the position of the row before."""
    w = T.along()
    return telemetry(spark, sf_dir).select("*", F.lag("lat").over(w).alias("lat0"), F.lag("lng").over(w).alias("lng0"), F.lag("speed_kmh").over(w).alias("speed0"))


PAIRS = "p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(speed_kmh) OVER w AS speed0 FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY seq))"
HAV = "2 * {r} * atan2(sqrt(h), sqrt(1 - h))"


def hav(a: str, b: str, c: str, d: str, r: float = G.RADIUS_EQUATOR) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(1 - {h})))"


BEAR = "atan2(sin(radians(lng - lng0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lng - lng0)))"


@query(f"""SELECT session_id, seq, round({hav("lat0", "lng0", "lat", "lng")}, 6) AS step_m, round({hav("lat0", "lng0", "lat", "lng", G.RADIUS_MEAN)}, 6) AS step_mean_m,
  round({G.RADIUS_MEAN} * radians(lng - lng0) * cos(radians(lat0)), 6) AS east_m, round({G.RADIUS_MEAN} * radians(lat - lat0), 6) AS north_m, round(lat, 6) AS back_lat, round(lng, 6) AS back_lng,
  CASE WHEN abs(lat - lat0) < 1e-7 AND abs(lng - lng0) < 1e-7 THEN 0.0 ELSE round(floor(((degrees({BEAR}) + 360) % 360) * 10 + 0.5) / 10, 6) END AS bearing_deg, round({BEAR}, 6) AS bearing_rad, round(lat, 6) AS end_lat, round(lng, 6) AS end_lng
FROM p WHERE lat0 IS NOT NULL""".replace("FROM p", "FROM p", 1))
def geodesy_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat0, lng0, lat, lng = (F.col(c) for c in ("lat0", "lng0", "lat", "lng"))
    p = pairs(spark, sf_dir).where("lat0 IS NOT NULL")
    e, n = G.east(lng, lat0, lng0), G.north(lat, lat0)
    step, turn = G.haversine(lat0, lng0, lat, lng), G.bearing_radians(lat0, lng0, lat, lng)
    end_lat, end_lng = G.destination(lat0, lng0, step, turn)
    return rounded(p.select(*COLUMNS, step.alias("step_m"), G.haversine(lat0, lng0, lat, lng, G.RADIUS_MEAN).alias("step_mean_m"), e.alias("east_m"), n.alias("north_m"), G.latitude_at(n, lat0).alias("back_lat"), G.longitude_at(e, lat0, lng0).alias("back_lng"), G.bearing_degrees(lat0, lng0, lat, lng).alias("bearing_deg"), turn.alias("bearing_rad"), end_lat.alias("end_lat"), end_lng.alias("end_lng")))


ORACLES["geodesy_steps"] = ORACLES["geodesy_steps"].replace(TELEMETRY, f"{TELEMETRY}, {PAIRS}")


def _share(c: str) -> str:
    return f"greatest(0, least(1, ((lng - 75.87) * {c} * 0.03 * {c} + (lat - 17.63) * 0.01) / (0.03 * {c} * 0.03 * {c} + 0.01 * 0.01)))"


@query(f"""SELECT session_id, seq, round({_share("1")}, 6) AS share_raw, round(17.63 + {_share("1")} * 0.01, 8) AS lat_raw, round({_share("cos(radians(lat))")}, 6) AS share_scaled, round(75.87 + {_share("cos(radians(lat))")} * 0.03, 8) AS lng_scaled,
  round(sqrt(pow({G.RADIUS_MEAN} * radians(75.87 - lng + {_share("cos(radians(lat))")} * 0.03) * cos(radians(lat)), 2) + pow({G.RADIUS_MEAN} * radians(17.63 - lat + {_share("cos(radians(lat))")} * 0.01), 2)), 5) AS distance_m FROM tel""")
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.lit(x) for x in (17.63, 75.87, 17.64, 75.90)]
    lat, lng = F.col("lat"), F.col("lng")
    raw, scaled, metres = G.project(lat, lng, *ends, scaled=False), G.project(lat, lng, *ends), G.project_metres(lat, lng, *ends)
    return telemetry(spark, sf_dir).select(*COLUMNS, F.round(raw[0], 6).alias("share_raw"), F.round(raw[1], 8).alias("lat_raw"), F.round(scaled[0], 6).alias("share_scaled"), F.round(scaled[2], 8).alias("lng_scaled"), F.round(metres[1], 5).alias("distance_m"))


@query("""SELECT session_id, seq, round(speed_kmh / 3.6 * sin(radians(k * 3.6)), 6) AS v_east, round(speed_kmh / 3.6 * cos(radians(k * 3.6)), 6) AS v_north,
  round(0.5 * sin(radians(k)) + 0.25 * cos(radians(k)), 6) AS a_east, round(0.5 * cos(radians(k)) - 0.25 * sin(radians(k)), 6) AS a_north,
  round(cos(k / 50) * cos(0.2), 6) AS r11, round(-sin(0.2), 6) AS r31, round(cos(0.2) * cos(0.1), 6) AS r33,
  round(1 / sqrt(1 + pow(k / 2000, 2)), 6) AS q_w, round((k / 2000) / sqrt(1 + pow(k / 2000, 2)), 6) AS q_z, round(1 - 2 * pow((k / 2000) / sqrt(1 + pow(k / 2000, 2)), 2), 6) AS m11,
  round(2 * (k / 2000) / (1 + pow(k / 2000, 2)), 6) AS twice_z, round((k * 7) % 360, 6) AS heading, round(sqrt(speed_kmh * speed_kmh + k * k + 1), 6) AS size,
  round((speed_kmh + 0.2 * CASE WHEN ((k * 7 - speed_kmh) % 360 + 360) % 360 > 180 THEN ((k * 7 - speed_kmh) % 360 + 360) % 360 - 360 ELSE ((k * 7 - speed_kmh) % 360 + 360) % 360 END + 720) % 360, 6) AS smoothed FROM tel""")
def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k"), F.col("speed_kmh") / 3.6
    half, quarter = F.lit(0.5), F.lit(0.25)
    r = G.rotation_matrix(F.lit(0.1), F.lit(0.2), k / 50)
    q = G.quaternion_of_rates(F.lit(0.0), F.lit(0.0), k / 10, 0.01)
    return rounded(telemetry(spark, sf_dir).select(*COLUMNS, G.velocity_east(v, k * 3.6).alias("v_east"), G.velocity_north(v, k * 3.6).alias("v_north"), G.body_to_east(quarter, half, k).alias("a_east"), G.body_to_north(quarter, half, k).alias("a_north"), r[0].alias("r11"), r[6].alias("r31"), r[8].alias("r33"), q["w"].alias("q_w"), q["z"].alias("q_z"), G.quaternion_matrix(q)[0].alias("m11"), G.quaternion_product(q, q)["z"].alias("twice_z"), G.normalised_degrees(k * 7).alias("heading"), G.magnitude(F.col("speed_kmh"), k, F.lit(1.0)).alias("size"), G.smoothed_heading(F.col("speed_kmh"), k * 7, 0.2).alias("smoothed")))


@query("""SELECT session_id, seq, CASE WHEN k < 10 THEN 0.0 ELSE round(speed_kmh, 6) END AS cleaned, round((speed_kmh - 50) / 20, 6) AS z_speed, round((k - 40) / 10, 6) AS z_k, round(speed_kmh, 6) AS back,
  round(least(1, sqrt(pow((speed_kmh - 50) / 20, 2) + pow((k - 40) / 10, 2)) / 3), 6) AS size, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS valid, true AS on_route, least(100, greatest(1, accuracy_m)) < 50 AND abs(lat) > 0.1 AS usable FROM tel""")
def cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k"), F.col("speed_kmh")
    means, deviations = F.array(F.lit(50.0), F.lit(40.0)), F.array(F.lit(20.0), F.lit(10.0))
    z = G.z_scores(F.array(v, k), means, deviations)
    broken = F.when(k < 3, F.lit(None)).when(k < 6, F.lit(float("nan"))).when(k < 10, F.lit(float("-inf"))).otherwise(v)
    return rounded(telemetry(spark, sf_dir).select(*COLUMNS, G.finite_or_zero(broken).alias("cleaned"), z[0].alias("z_speed"), z[1].alias("z_k"), G.from_z_scores(z, means, deviations)[0].alias("back"), G.correction_size(z).alias("size"), G.valid_position(F.col("lat"), F.col("lng")).alias("valid"), G.valid_route_point(F.col("lat"), F.col("lng")).alias("on_route"), G.usable_fix(F.col("lat"), F.col("accuracy_m")).alias("usable")))


@query("""SELECT session_id, seq, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(CAST(floor(((k * 3.6) % 360) / 45 + 0.5) AS BIGINT) % 8 AS INT) + 1] AS wind,
  CASE WHEN speed_kmh / 100 < 1 THEN CAST(CAST(floor(speed_kmh / 100 * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' m' ELSE 'km' END AS distance,
  CAST(CAST(floor(k * 61) AS BIGINT) // 60 AS VARCHAR) || 'm ' || CAST(CAST(floor(k * 61) AS BIGINT) % 60 AS VARCHAR) || 's' AS duration, CAST(CAST(k * 61 AS BIGINT) // 3600 AS VARCHAR) || 'h ' || CAST(CAST(k * 61 AS BIGINT) % 3600 // 60 AS VARCHAR) || 'm' AS hours,
  CASE WHEN seq = 1 THEN ['Start walking on ', 'Head out cycling on ', 'Head on '][CAST(k AS INT) % 3 + 1] || street WHEN k < 20 THEN 'Turn sharp left onto ' || street WHEN k < 30 THEN 'Turn ahead onto ' || street WHEN k < 40 THEN 'Take the left fork onto ' || street WHEN k < 50 THEN 'Take the slight fork onto ' || street WHEN k < 60 THEN 'Enter roundabout and take exit onto ' || street WHEN k < 70 THEN 'Continue on ' || street WHEN k < 80 THEN 'Arrive at destination (' || street || ')' WHEN k < 90 THEN 'merge onto ' || street ELSE 'Proceed onto ' || street END AS turn,
  round(floor(-speed_kmh * 10 + 0.5) / 10, 6) AS half_up, CASE WHEN is_dr THEN 'DEAD RECKONING' WHEN speed_kmh > 400 THEN 'GNSS REJECTED' WHEN accuracy_m >= 10 THEN 'GNSS DEGRADED' ELSE 'GNSS' END AS badge,
  CAST(CASE WHEN NOT is_dr AND k < 50 THEN 1 WHEN NOT is_dr THEN 2 WHEN k < 50 THEN 3 ELSE 4 END AS BIGINT) AS scenario FROM (SELECT *, CASE WHEN CAST(k AS INT) % 7 = 0 THEN 'path' ELSE event_type END AS street FROM tel)""")
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, dr = F.col("k"), F.col("speed_kmh"), F.col("is_dr")
    km = v / 100
    kind = F.when(F.col("seq") == 1, "depart").when(k < 20, "turn").when(k < 30, "end of road").when(k < 50, "fork").when(k < 60, "rotary").when(k < 70, "continue").when(k < 80, "arrive").when(k < 90, "merge")
    modifier = F.when(k < 20, "sharp-left").when((k >= 30) & (k < 40), "left").when(k < 25, "")
    street, vehicle = F.when(k.cast("int") % 7 != 0, F.col("event_type")), F.element_at(F.array(*map(F.lit, ("walking", "bike", "car"))), k.cast("int") % 3 + 1)
    return rounded(telemetry(spark, sf_dir).select(*COLUMNS, L.cardinal(k * 3.6).alias("wind"), F.when(km < 1, L.distance_text(km)).otherwise("km").alias("distance"), L.duration_text(k * 61).alias("duration"), L.duration_text(k * 61, hours=True).alias("hours"), L.vehicle_instruction(kind, modifier, street, vehicle).alias("turn"), G.half_up(-v, 1).alias("half_up"), L.source_badge(F.when(dr, "IDR").otherwise("GNSS"), v > 400, L.gnss_state(F.col("accuracy_m"), F.lit(None).cast("int"), F.lit(None).cast("double"))).alias("badge"), L.connectivity(~dr, k < 50).alias("scenario")))


@query("""SELECT DISTINCT session_id, CAST(floor(lat / 0.025) AS BIGINT) AS cell_row, CAST(floor(lng / 0.025) AS BIGINT) AS cell_col, CAST(CAST(floor(lat / 0.025) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(lng / 0.025) AS BIGINT) AS VARCHAR) AS cell_key,
  CAST(floor(lat / 0.025) AS BIGINT) + a AS near_row, CAST(floor(lng / 0.025) AS BIGINT) + b AS near_col FROM tel, range(-1, 2) x(a), range(-1, 2) y(b)""")
def road_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    cells = telemetry(spark, sf_dir).select("session_id", G.cell_index(lat).alias("cell_row"), G.cell_index(lng).alias("cell_col"), G.cell_key(lat, lng).alias("cell_key")).distinct()
    middle = (F.col("cell_row") + 0.5) * G.CELL_DEGREES, (F.col("cell_col") + 0.5) * G.CELL_DEGREES
    return cells.withColumn("near", F.explode(G.neighbourhood(*middle))).select("session_id", "cell_row", "cell_col", "cell_key", F.col("near.row").alias("near_row"), F.col("near.column").alias("near_col"))


@query("""SELECT session_id, CAST(((((('0x' || substr(m, 1, 8))::BIGINT % 1000000 * 967296 + ('0x' || substr(m, 9, 8))::BIGINT) % 1000000) * 967296 + ('0x' || substr(m, 17, 8))::BIGINT) % 1000000 * 967296 + ('0x' || substr(m, 25, 8))::BIGINT) % 1000000 AS BIGINT) AS seed
FROM (SELECT DISTINCT session_id, md5(CAST(session_id AS VARCHAR)) AS m FROM tel)""")
def stable_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("session_id").distinct().select("session_id", G.text_seed(F.col("session_id").cast("string")).alias("seed"))


STEPS = f"s AS (SELECT *, coalesce({hav('lat0', 'lng0', 'lat', 'lng')}, 0) AS step FROM p)"
BASE = f"WITH {TELEMETRY}, {PAIRS}, {STEPS}"

ORACLES["outage_spans"] = f"""{BASE}, m AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS island, lead(lat) OVER w AS nlat FROM s WHERE is_dr WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
n AS (SELECT session_id, seq AS nseq, lead(lat) OVER w AS next_lat, lead(lng) OVER w AS next_lng, lag(is_dr) OVER w AS was FROM s WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
i AS (SELECT m.*, next_lat, next_lng, CASE WHEN was THEN step ELSE 0 END AS inside FROM m JOIN n ON m.session_id = n.session_id AND m.seq = n.nseq)
SELECT session_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_rows, round(sum(inside), 6) AS progress_m, round(max(inside), 6) AS max_step_m, round(quantile_cont(inside, 0.95), 6) AS p95_step_m, round(avg(speed_kmh), 6) AS avg_speed_kmh,
  max(t_ms) - min(t_ms) AS duration_ms, round({hav("max_by(lat, seq)", "max_by(lng, seq)", "max_by(next_lat, seq)", "max_by(next_lng, seq)")}, 6) AS endpoint_error_m FROM i GROUP BY session_id, island""".replace("max_by(next_lat, seq)", "max_by(coalesce(next_lat, 'nan'::DOUBLE), seq)").replace("max_by(next_lng, seq)", "max_by(coalesce(next_lng, 'nan'::DOUBLE), seq)")


def outage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.outage_spans(telemetry(spark, sf_dir)))


ORACLES["outage_spans"] = f"SELECT * REPLACE (CASE WHEN isnan(endpoint_error_m) THEN NULL ELSE endpoint_error_m END AS endpoint_error_m) FROM ({ORACLES['outage_spans']})"
QUERIES["outage_spans"] = outage_spans


def step_query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = BASE + sql
        return f

    return register


@step_query(""", r AS (SELECT *, speed_kmh > 100 AND step < 500 AS met FROM s), g AS (SELECT *, sum(CASE WHEN met THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS grp FROM r),
c AS (SELECT session_id, CASE WHEN met THEN sum(CASE WHEN met THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, grp ORDER BY seq) ELSE 0 END AS n FROM g) SELECT session_id, CAST(max(n) AS BIGINT) AS longest_frozen FROM c GROUP BY session_id""")
def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.longest_frozen(telemetry(spark, sf_dir), 100.0, 500.0)


@step_query(""" SELECT session_id, count(*) AS n_points, round(sum(step) / 1000, 6) AS path_km, round((max(t_ms) - min(t_ms)) / 1000, 6) AS duration_s, count(*) FILTER (NOT is_dr) AS n_gnss, count(*) FILTER (is_dr) AS n_dr, CAST(floor(100 * count(*) FILTER (NOT is_dr) / count(*) + 0.5) AS BIGINT) AS gnss_pct, CAST(floor(100 * count(*) FILTER (is_dr) / count(*) + 0.5) AS BIGINT) AS dr_pct, round(avg(speed_kmh), 6) AS avg_kmh, round(max(speed_kmh), 6) AS max_kmh FROM s GROUP BY session_id""")
def trip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.trip_summary(telemetry(spark, sf_dir)))


@step_query(""", d AS (SELECT session_id, t_ms, speed_kmh, (t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY seq)) / 1000 AS dt FROM s), b AS (SELECT session_id, count(*) AS n_rows, (max(t_ms) - min(t_ms)) / 1000 AS duration_s, median(dt) AS median_dt, min(dt) AS min_dt, max(dt) AS max_dt, count(*) - count(DISTINCT t_ms) AS n_duplicates, 0 AS n_missing, min(speed_kmh) AS min_speed, max(speed_kmh) AS max_speed, avg(speed_kmh) AS mean_speed, stddev_pop(speed_kmh) AS std_speed FROM d GROUP BY session_id)
SELECT b.session_id, n_rows, round(duration_s, 6) AS duration_s, round(median_dt, 6) AS median_dt, round(min_dt, 6) AS min_dt, round(max_dt, 6) AS max_dt, n_duplicates, CAST(n_missing AS BIGINT) AS n_missing, round(min_speed, 6) AS min_speed, round(max_speed, 6) AS max_speed, round(mean_speed, 6) AS mean_speed, round(std_speed, 6) AS std_speed, count(*) FILTER (dt > 2 * median_dt) AS n_gaps, round(1 / median_dt, 6) AS hz
FROM b JOIN d ON b.session_id = d.session_id GROUP BY ALL""".replace("FROM b JOIN d ON b.session_id = d.session_id GROUP BY ALL", "FROM b JOIN d ON b.session_id = d.session_id GROUP BY b.session_id, n_rows, duration_s, median_dt, min_dt, max_dt, n_duplicates, n_missing, min_speed, max_speed, mean_speed, std_speed"))
def session_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.session_diagnostics(telemetry(spark, sf_dir)))


@step_query(""", r AS (SELECT *, t_ms % 100000000 AS raw FROM s), f AS (SELECT *, greatest(lag(raw) OVER w - raw, 0) AS fall FROM r WINDOW w AS (PARTITION BY session_id ORDER BY seq)), u AS (SELECT *, raw + CAST(sum(CASE WHEN fall > 0 THEN fall + 100 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS t_unwrapped FROM f)
SELECT session_id, seq, t_unwrapped, round((t_unwrapped - first(t_unwrapped) OVER (PARTITION BY session_id ORDER BY seq)) / 1000, 6) AS t_rel FROM u""")
def clock_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.unwrapped(telemetry(spark, sf_dir).withColumn("raw", F.col("t_ms") % 100000000), "raw")
    return rounded(T.seconds_from_start(rows, "t_unwrapped").select(*COLUMNS, "t_unwrapped", "t_rel"))


@step_query(""", a AS (SELECT *, k - avg(CASE WHEN seq <= 10 THEN k END) OVER (PARTITION BY session_id) AS acc, seq * CAST(0.1 AS DOUBLE) AS t FROM s), q AS (SELECT *, coalesce(0.5 * (acc + lag(acc) OVER w) * greatest(t - lag(t) OVER w, 1e-6), 0) AS area, event_type = 'signup' AS reset FROM a WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
l AS (SELECT *, sum(CAST(reset AS INT)) OVER (PARTITION BY session_id ORDER BY seq) AS leg FROM q)
SELECT session_id, seq, round(acc, 6) AS acc, round(sum(area) OVER (PARTITION BY session_id ORDER BY seq), 6) AS velocity, round(CASE WHEN leg > 0 THEN first(speed_kmh) OVER g ELSE 0 END + sum(CASE WHEN reset THEN 0 ELSE area END) OVER g, 6) AS corrected FROM l WINDOW g AS (PARTITION BY session_id, leg ORDER BY seq)""")
def integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.without_initial_bias(telemetry(spark, sf_dir), "k", "acc", 10).withColumn("t", F.col("seq") * 0.1)
    rows = T.trapezoid(rows, "acc", "t", "velocity")
    return rounded(T.resettable_trapezoid(rows, "acc", "t", F.col("event_type") == "signup", "speed_kmh", "corrected").select(*COLUMNS, "acc", "velocity", "corrected"))


@step_query(""", c AS (SELECT *, k < 30 AS calm FROM s), g AS (SELECT *, sum(CASE WHEN calm THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS grp FROM c)
SELECT session_id, seq, round(avg(k) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS mean_15, round(sqrt(var_pop(k) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + var_pop(speed_kmh) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 5) AS dev_20,
  count(*) OVER (PARTITION BY session_id ORDER BY t_ms RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS recent, CASE WHEN calm THEN CAST(sum(CASE WHEN calm THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, grp ORDER BY seq) AS BIGINT) ELSE 0 END AS calm_run FROM g WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
def moving_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.along()
    last15, last20 = w.rowsBetween(-14, 0), w.rowsBetween(-19, 0)
    rows = T.consecutive(telemetry(spark, sf_dir), F.col("k") < 30, "calm_run")
    return rounded(rows.select(*COLUMNS, F.avg("k").over(last15).alias("mean_15"), F.round(F.sqrt(F.var_pop("k").over(last20) + F.var_pop("speed_kmh").over(last20)), 5).alias("dev_20"), F.count(F.lit(1)).over(T.along("t_ms").rangeBetween(-999999, 0)).alias("recent"), "calm_run"))


@step_query(""", m AS (SELECT *, is_dr AND speed_kmh < 60 AS slow FROM s), g AS (SELECT *, CASE WHEN slow THEN seq - row_number() OVER (PARTITION BY session_id, slow ORDER BY seq) ELSE -seq END AS grp FROM m)
SELECT session_id, max(seq) AS seq, round(max_by(lat, seq), 6) AS lat, round(max_by(lng, seq), 6) AS lng, count(*) AS kept_for FROM g GROUP BY session_id, slow, grp""")
def stationary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.compressed_stationary(telemetry(spark, sf_dir), 60.0))


@step_query(""", g AS (SELECT *, sum(CASE WHEN is_dr THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS grp FROM s) SELECT session_id, seq, CASE WHEN is_dr THEN CAST(sum(CAST(is_dr AS INT)) OVER (PARTITION BY session_id, grp ORDER BY seq) AS BIGINT) ELSE 0 END AS dr_step FROM g""")
def dr_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.steps_since_anchor(telemetry(spark, sf_dir)).select(*COLUMNS, "dr_step"))


@step_query(""", f AS (SELECT *, k / 100 AS va, k / 200 AS vg, speed_kmh / 10 AS v FROM s), a AS (SELECT session_id, seq, CASE WHEN v < 0.8 AND va < 0.035 AND vg < 0.02 THEN ['STATIONARY', '0.95'] WHEN v <= 9 AND va BETWEEN 0.035 AND 0.8 AND vg BETWEEN 0.01 AND 0.5 THEN ['PEDESTRIAN', CASE WHEN v <= 6 THEN '0.9' ELSE '0.75' END] WHEN v > 8 AND v <= 35 AND vg > 0.04 AND va < 0.3 THEN ['CYCLING', '0.7']
  WHEN v > 10 OR (va BETWEEN 0.15 AND 0.65 AND vg <= 0.08) THEN ['AUTOMOTIVE', CASE WHEN v > 20 THEN '0.95' ELSE '0.8' END] WHEN v > 15 THEN ['AUTOMOTIVE', '0.6'] WHEN v > 0.8 THEN ['PEDESTRIAN', '0.6'] ELSE ['STATIONARY', '0.8'] END AS x FROM f),
h AS (SELECT session_id, seq, x, list(x[1]) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM a)
SELECT session_id, seq, x[1] AS raw, CAST(x[2] AS DOUBLE) AS confidence, list_aggregate(list_transform(list_distinct(recent), lambda y: struct_pack(n := len(list_filter(recent, lambda z: z = y)), p := -list_position(recent, y), l := y)), 'max').l AS activity FROM h""")
def motion_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = telemetry(spark, sf_dir).withColumn("m", L.motion_class(F.col("speed_kmh") / 10, k / 100, k / 200, F.lit(0.0))).withColumns({"raw": F.col("m.activity"), "confidence": F.col("m.confidence")})
    return T.majority(rows, "raw", "activity").select(*COLUMNS, "raw", "confidence", "activity")


@step_query(""", t AS (SELECT session_id, t_ms, min(speed_kmh) AS v, min(lat) AS la FROM s WHERE NOT is_dr GROUP BY session_id, t_ms), q AS (SELECT session_id, seq, t_ms FROM s WHERE is_dr),
j AS (SELECT q.*, max(t.t_ms) FILTER (t.t_ms <= q.t_ms) AS ta, min(t.t_ms) FILTER (t.t_ms >= q.t_ms) AS tb FROM q LEFT JOIN t ON q.session_id = t.session_id GROUP BY q.session_id, q.seq, q.t_ms),
x AS (SELECT j.*, a.v AS va, b.v AS vb, a.la AS laa, b.la AS lab, CASE WHEN ta = tb THEN 0 ELSE (j.t_ms - ta) / (tb - ta) END AS w FROM j LEFT JOIN t a ON j.session_id = a.session_id AND a.t_ms = ta LEFT JOIN t b ON j.session_id = b.session_id AND b.t_ms = tb)
SELECT session_id, seq, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + w * (vb - va) END, 6) AS true_speed_kmh, round(CASE WHEN laa IS NULL THEN lab WHEN lab IS NULL THEN laa ELSE laa + w * (lab - laa) END, 6) AS true_lat FROM x""")
def interpolated_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    return rounded(T.interpolated(tel.where("is_dr").select("session_id", "seq", "t_ms"), tel.where("NOT is_dr"), "t_ms", ["speed_kmh", "lat"]).select(*COLUMNS, "true_speed_kmh", "true_lat"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.drift(telemetry(spark, sf_dir), F.col("speed_kmh") - 2 * F.col("k"))


DRIFT = ", d AS (SELECT session_id, sqrt(avg(pow(speed_kmh - 2 * k, 2))) AS rmse, avg(abs(speed_kmh - 2 * k)) AS mae, max_by(speed_kmh - 2 * k, seq) AS final_error, sum(step) AS path_m FROM s GROUP BY session_id), e AS (SELECT *, CASE WHEN path_m >= 1 THEN 100 * abs(final_error) / path_m ELSE CAST('infinity' AS DOUBLE) END AS drift_pct FROM d)"


@step_query(DRIFT + " SELECT session_id, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(final_error, 6) AS final_error, round(path_m, 6) AS path_m, round(drift_pct, 6) AS drift_pct FROM e")
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_errors(spark, sf_dir))


@step_query(DRIFT + " SELECT count(*) AS n_sessions, round(avg(drift_pct), 6) AS mean_drift, round(median(drift_pct), 6) AS median_drift, round(quantile_cont(drift_pct, 0.95), 6) AS p95_drift, round(100 * (1 - median(drift_pct) / avg(drift_pct)), 6) AS gain_pct FROM e WHERE drift_pct < 1e6")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("drift_pct")
    sane = _errors(spark, sf_dir).where((d < 1e6) & ~F.isnan(d))
    return rounded(sane.agg(F.count(F.lit(1)).alias("n_sessions"), F.avg(d).alias("mean_drift"), F.median(d).alias("median_drift"), F.percentile(d, 0.95).alias("p95_drift"), (100 * (1 - F.median(d) / F.avg(d))).alias("gain_pct")))


@step_query(""" SELECT session_id, seq, CASE WHEN 200 - 2 * k > 150 OR CAST(k % 12 AS INT) < 4 OR speed_kmh / 60 > 5 THEN 'WEAK_LOST' WHEN 200 - 2 * k >= 10 OR speed_kmh / 60 > 2 OR CAST(k % 12 AS INT) < 6 THEN 'DEGRADED' ELSE 'GOOD' END AS state,
  round((CASE WHEN 200 - 2 * k < 10 THEN 1.0 WHEN 200 - 2 * k <= 50 THEN (200 - 2 * k) / 10 WHEN 200 - 2 * k <= 150 THEN 5 + 2 * pow((200 - 2 * k - 50) / 10, 2) ELSE 500 END) * (CASE WHEN speed_kmh / 60 > 1.5 THEN least(speed_kmh / 60 / 1.5, 5) ELSE 1 END) * (CASE WHEN CAST(k % 12 AS INT) <= 3 THEN 3.0 WHEN CAST(k % 12 AS INT) < 6 THEN 1.5 ELSE 1.0 END), 6) AS noise,
  CASE WHEN accuracy_m > 25 THEN 'WEAK_LOST' WHEN accuracy_m > 10 THEN 'DEGRADED' ELSE 'GOOD' END AS simple_state, round(pow(accuracy_m / 5, 2), 6) AS simple_noise, CASE WHEN step / 10 * 3.6 > 60 AND is_dr THEN 'CRITICAL' WHEN step > 100 THEN 'HIGH' ELSE 'NONE' END AS severity,
  CASE WHEN 200 - 2 * k < 10 THEN NULL ELSE last(CASE WHEN k % 10 >= 5 THEN k END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) END AS held FROM s""")
def gnss_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy, satellites, hdop = 200 - 2 * F.col("k"), (F.col("k") % 12).cast("int"), F.col("speed_kmh") / 60
    rows = telemetry(spark, sf_dir).withColumn("step", T.step_distance())
    held = F.last(F.when(F.col("k") % 10 >= 5, F.col("k")), ignorenulls=True).over(T.along())
    return rounded(rows.select(*COLUMNS, L.gnss_state(accuracy, satellites, hdop).alias("state"), L.noise_scale(accuracy, satellites, hdop).alias("noise"), L.simple_gnss_state(F.col("accuracy_m")).alias("simple_state"), L.simple_noise_scale(F.col("accuracy_m")).alias("simple_noise"), L.gnss_anomaly(F.col("step"), F.lit(10.0), ~F.col("is_dr"), F.col("step"))["severity"].alias("severity"), F.when(accuracy < 10, None).otherwise(held).alias("held")))


@step_query(""" SELECT session_id, round(list_reduce(list(speed_kmh ORDER BY seq), lambda a, x: a + CAST(0.05 AS DOUBLE) * (x - a)), 6) AS filtered FROM s GROUP BY session_id""")
def ema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(telemetry(spark, sf_dir).select("session_id", "seq", "speed_kmh"), Ema(0.05), ["speed_kmh"])
    return rounded(found.groupBy("session_id").agg(F.max_by("filtered", "seq").alias("filtered")))


@step_query(""" SELECT session_id, seq, seq * 0.1 BETWEEN lo + 0.4 * (hi - lo) AND lo + 0.4 * (hi - lo) + 2.0 AS blackout, seq - 1 >= floor(n * CAST(0.4 AS DOUBLE)) AND seq - 1 < floor(n * CAST(0.4 AS DOUBLE)) + 20 AS blackout_row FROM (SELECT *, min(seq * CAST(0.1 AS DOUBLE)) OVER w AS lo, max(seq * CAST(0.1 AS DOUBLE)) OVER w AS hi, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY session_id))""".replace("seq * 0.1 BETWEEN lo", "seq * CAST(0.1 AS DOUBLE) BETWEEN lo").replace("0.4 * (hi", "CAST(0.4 AS DOUBLE) * (hi"))
def blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.in_blackout(telemetry(spark, sf_dir).withColumn("t_sec", F.col("seq") * 0.1), seconds=2.0)
    return T.in_blackout_rows(rows).select(*COLUMNS, "blackout", "blackout_row")


@step_query(""", m AS (SELECT *, lag(is_dr) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM s), c AS (SELECT session_id, seq, t_ms, is_dr, lead(t_ms) OVER (PARTITION BY session_id ORDER BY seq) AS returned_ms FROM m WHERE is_dr <> coalesce(was, false)) SELECT session_id, t_ms AS lost_ms, returned_ms, returned_ms - t_ms AS latency_ms FROM c WHERE is_dr""")
def outage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.outage_latency(telemetry(spark, sf_dir))


@step_query(""" SELECT session_id, count(*) FILTER (NOT is_dr) AS n_fixes, count(*) FILTER (is_dr AND speed_kmh > 5) AS rejected_moving, count(*) FILTER (is_dr AND speed_kmh <= 5) AS rejected_standing, round(max(abs(speed_kmh - speed0)), 6) AS max_delta_kmh FROM s GROUP BY session_id""")
def replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.replay_metrics(telemetry(spark, sf_dir)))


@step_query(""", a AS (SELECT *, t_ms - CAST(k AS BIGINT) * 10000000 AS arrival FROM s), l AS (SELECT *, max(arrival) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest, (t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY seq)) / 1000 AS dt FROM a) SELECT session_id, seq, round(dt, 6) AS dt, coalesce(dt > 0 AND dt <= 100000, false) AS used FROM l WHERE latest IS NULL OR arrival >= latest""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.clocked(telemetry(spark, sf_dir), most_s=100000.0).withColumn("arrival", F.col("t_ms") - F.col("k").cast("long") * 10000000)
    return rounded(T.not_late(rows, "arrival").select(*COLUMNS, "dt", "used"))


@step_query(""" SELECT session_id, seq, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM s) WHERE r <= 20""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_rows(telemetry(spark, sf_dir), 20).select(*COLUMNS, "t_ms")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outage_spans(spark, sf_dir)
