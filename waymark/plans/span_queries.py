"""Queries of spans, exports, live checks, the adaptive matching model and route steps, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import labels as L
from waymark.operators import persistence as P
from waymark.operators import roads as R
from waymark.operators import spans as S
from waymark.operators import trips as T
from waymark.plans.adapter import ROADS, TELEMETRY, both_ways, road_nodes, road_segments, table, telemetry
from waymark.plans.fleet_queries import NEAR, _metres_to_segment
from waymark.plans.trip_queries import hav, rounded
from waymark.sources.files import graph_edges

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _rejected() -> Column:
    return (F.col("event_type") == "click") & (F.col("k") < 30)


SPANS = f"""WITH {TELEMETRY}, r AS (SELECT *, event_type = 'click' AND k < 30 AS gnss_rejected FROM tel), o AS (SELECT *, is_dr OR gnss_rejected AS off FROM r), i AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS g FROM o WHERE off),
sp AS (SELECT session_id, min(seq) AS a, max(seq) AS b, row_number() OVER (PARTITION BY session_id ORDER BY min(seq)) AS span FROM i GROUP BY session_id, g),
parts AS (SELECT t.*, CAST(span AS BIGINT) AS span, CASE WHEN t.seq < a THEN 'before' WHEN t.seq > b THEN 'after' ELSE 'span' END AS role FROM sp JOIN o t ON t.session_id = sp.session_id AND t.seq BETWEEN a - 1 AND b + 1)"""


@query(SPANS + " SELECT session_id, span, seq, role FROM parts")
def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_rows(telemetry(spark, sf_dir), F.col("is_dr") | _rejected()).select("session_id", "span", "seq", "role")


def _share() -> str:
    """Share of the segment before the point's projection, on the plane that touches at the point."""
    east = "pow(cos(radians(lat)), 2)"
    return f"greatest(0, least(1, ((lng - lng1) * (lng2 - lng1) * {east} + (lat - lat1) * (lat2 - lat1)) / (pow(lng2 - lng1, 2) * {east} + pow(lat2 - lat1, 2))))"


SNAPPED = f"""d AS (SELECT {{keys}}, lat, lng, edge_id, lat1, lng1, lat2, lng2, {_metres_to_segment()} AS distance, {_share()} AS share FROM {{points}}, segments WHERE abs(lat1 - lat) < 0.002 AND abs(lng1 - lng) < 0.002),
near AS (SELECT *, lat1 + share * (lat2 - lat1) AS plat, lng1 + share * (lng2 - lng1) AS plng FROM d WHERE distance <= 20 QUALIFY row_number() OVER (PARTITION BY {{keys}} ORDER BY round(distance, 6), edge_id) = 1)"""


def _verdicts() -> str:
    back = "lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(mlat) OVER w AS mlat0, lag(mlng) OVER w AS mlng0, lead(seq) OVER w IS NULL AS final"
    return f"""{SPANS}, {ROADS}, {SNAPPED.format(keys="session_id, span, seq", points="parts")}, m AS (SELECT p.*, coalesce(n.plat, p.lat) AS mlat, coalesce(n.plng, p.lng) AS mlng FROM parts p LEFT JOIN near n ON p.session_id = n.session_id AND p.span = n.span AND p.seq = n.seq),
 st AS (SELECT *, {back} FROM m WINDOW w AS (PARTITION BY session_id, span ORDER BY seq)),
 v AS (SELECT session_id, span, count(*) AS n, bool_or(final AND NOT is_dr) AND count(*) > 1 AS anchored, coalesce(sum(CASE WHEN final THEN {hav("lat0", "lng0", "lat", "lng")} END), 0) AS raw_error_m, coalesce(sum(CASE WHEN final THEN {hav("mlat0", "mlng0", "lat", "lng")} END), 0) AS matched_error_m,
 coalesce(sum(CASE WHEN NOT final THEN {hav("lat0", "lng0", "lat", "lng")} END), 0) AS raw_progress_m, coalesce(sum(CASE WHEN NOT final THEN {hav("mlat0", "mlng0", "mlat", "mlng")} END), 0) AS matched_progress_m FROM st GROUP BY session_id, span),
 verdicts AS (SELECT *, CASE WHEN NOT anchored THEN 'kept' WHEN matched_error_m > raw_error_m + 1 THEN 'worse endpoint' WHEN raw_progress_m > 5 AND matched_progress_m < 0.7 * raw_progress_m THEN 'lost progress' ELSE 'kept' END AS verdict FROM v)"""


def _snapped_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = telemetry(spark, sf_dir)
    parts = S.span_rows(rows, F.col("is_dr") | _rejected())
    found = R.snapped(parts, road_segments(spark, sf_dir), keys=[*S.SPAN, "seq"])
    return rows, found.withColumnsRenamed({"proj_lat": "matched_lat", "proj_lng": "matched_lng"})


@query(_verdicts() + " SELECT session_id, span, anchored, round(raw_error_m, 4) AS raw_error_m, round(matched_error_m, 4) AS matched_error_m, round(raw_progress_m, 4) AS raw_progress_m, round(matched_progress_m, 4) AS matched_progress_m, verdict FROM verdicts")
def span_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans matched by their nearest street, then judged."""
    return rounded(S.span_verdicts(_snapped_spans(spark, sf_dir)[1]), 4)


@query(_verdicts() + " SELECT t.session_id, t.seq, x.span, x.verdict, round(x.plat, 8) AS matched_lat, round(x.plng, 8) AS matched_lng FROM tel t LEFT JOIN (SELECT p.session_id, p.seq, p.span, v.verdict, CASE WHEN v.verdict = 'kept' THEN n.plat END AS plat, CASE WHEN v.verdict = 'kept' THEN n.plng END AS plng FROM parts p JOIN verdicts v ON p.session_id = v.session_id AND p.span = v.span LEFT JOIN near n ON p.session_id = n.session_id AND p.span = n.span AND p.seq = n.seq WHERE p.role = 'span') x ON t.session_id = x.session_id AND t.seq = x.seq")
def spans_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of spans matched by their nearest street, written back where they do no harm."""
    rows, found = _snapped_spans(spark, sf_dir)
    return rounded(S.written_back(rows, found, S.span_verdicts(found)).select("session_id", "seq", "span", "verdict", "matched_lat", "matched_lng"), 8)


@query()
def spans_map_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the hidden-Markov matcher, each span with its anchors as one sequence; tests compare it with a plain version."""
    s = road_segments(spark, sf_dir)
    rows = telemetry(spark, sf_dir)
    found = S.matched_spans(rows, both_ways(s), F.col("is_dr") | _rejected())
    return rounded(S.written_back(rows, found, S.span_verdicts(found)).select("session_id", "seq", "span", "verdict", "matched_lat", "matched_lng"), 8)


def _live() -> str:
    lat1, lng1, lat2, lng2 = "radians(lat1)", "radians(lng1)", "radians(lat2)", "radians(lng2)"
    along = f"degrees(atan2(sin({lng2} - {lng1}) * cos({lat2}), cos({lat1}) * sin({lat2}) - sin({lat1}) * cos({lat2}) * cos({lng2} - {lng1})))"
    pairs = NEAR.replace("lat, lng, accuracy_m, edge_id", f"lat, lng, k * 3.6 AS heading, speed_kmh / 3.6 AS speed, lat1, lng1, lat2, lng2, {_share()} AS share, edge_id")
    return pairs + f""", h AS (SELECT *, abs(((({along} - heading + 180) % 360) + 360) % 360 - 180) AS forth FROM d WHERE distance <= 20), g AS (SELECT *, least(forth, 180 - forth) AS turn FROM h),
 c AS (SELECT *, distance + CASE WHEN speed > 1 THEN radians(turn) * 10 ELSE 0 END AS cost FROM g WHERE NOT speed > 1 OR turn <= 45), b AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY round(cost, 6), edge_id) AS r FROM c),
 f AS (SELECT tel.session_id, tel.seq, tel.lat, tel.lng, is_dr AND coalesce(1 - distance / 20 > 0.4, false) AS snapped, lat1 + share * (lat2 - lat1) AS plat, lng1 + share * (lng2 - lng1) AS plng FROM tel LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON tel.session_id = b.session_id AND tel.seq = b.seq)
 SELECT session_id, seq, snapped, round(CASE WHEN snapped THEN plat ELSE lat END, 8) AS final_lat, round(CASE WHEN snapped THEN plng ELSE lng END, 8) AS final_lng FROM f"""


@query(_live())
def live_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumns({"heading": F.col("k") * 3.6, "speed": F.col("speed_kmh") / 3.6})
    return rounded(S.snapped_live(rows, road_segments(spark, sf_dir), heading="heading", speed="speed").select("session_id", "seq", "snapped", "final_lat", "final_lng"), 8)


LINES = f"""lines AS (SELECT *, sum(len) OVER (PARTITION BY edge_id ORDER BY leg) - len AS before FROM (SELECT CAST(a."row" AS BIGINT) AS edge_id, a.col AS leg, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2, {hav("a.lat", "a.lng", "b.lat", "b.lng")} AS len FROM nodes a JOIN nodes b ON a."row" = b."row" AND b.col = a.col + 1))"""


def _polylines() -> str:
    r = R.METRES_A_DEGREE
    plane = f"sqrt(pow((lng2 - lng1) * {r} * cos(radians(lat)), 2) + pow((lat2 - lat1) * {r}, 2))"
    return f"""WITH {TELEMETRY}, {ROADS}, {LINES}, d AS (SELECT session_id, seq, edge_id, leg, {_metres_to_segment()} AS distance, before + {_share()} * {plane} AS offset_m FROM tel, lines WHERE abs(lat1 - lat) < 0.002 AND abs(lng1 - lng) < 0.003),
 e AS (SELECT * FROM d WHERE distance <= 60 QUALIFY row_number() OVER (PARTITION BY session_id, seq, edge_id ORDER BY round(distance, 6), leg) = 1)
 SELECT session_id, seq, edge_id, CAST(row_number() OVER (PARTITION BY session_id, seq ORDER BY round(distance, 6), edge_id) AS BIGINT) AS rank, round(distance, 4) AS distance_m, round(offset_m, 3) AS offset_m FROM e QUALIFY rank <= 8"""


@query(_polylines())
def polyline_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates among whole streets of 41 points."""
    lines = road_nodes(spark, sf_dir).groupBy(F.col("row").alias("edge_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("points"))
    found = R.polyline_candidates(telemetry(spark, sf_dir).select("session_id", "seq", "lat", "lng"), lines, keys=["session_id", "seq"])
    return found.select("session_id", "seq", "edge_id", F.col("rank").cast("long").alias("rank"), F.round("distance_m", 4).alias("distance_m"), F.round("offset_m", 3).alias("offset_m"))


ADAPTIVE = f"""WITH {TELEMETRY}, a AS (SELECT *, seq - coalesce(max(CASE WHEN NOT is_dr THEN seq END) OVER w, 0) AS dr_step, lag(speed_kmh) OVER w AS was, lag(is_dr) OVER w AS dr0, greatest(0.1, (t_ms - lag(t_ms) OVER w) / 1000.0) AS dt, accuracy_m - 30 AS acc FROM tel WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
b AS (SELECT *, CASE WHEN is_dr THEN greatest(6, least(20, greatest(CASE WHEN acc > 0 THEN acc ELSE 10 END, 8 + least(8, 0.4 * dr_step)))) WHEN acc > 1 THEN greatest(2, least(acc, 8)) ELSE 4.07 END AS sigma, CASE WHEN was IS NOT NULL THEN greatest(5, least(25, 5 + 0.25 * greatest(speed_kmh, was) / 3.6 * (dt / (1000 * pi())) + CASE WHEN is_dr OR dr0 THEN 4 ELSE 0 END)) END AS beta FROM a)
SELECT session_id, seq, round(sigma, 6) AS sigma, round(beta, 6) AS beta, round(greatest(-100, -ln(sqrt(2 * pi()) * sigma) - 0.5 * pow(k / sigma, 2)), 6) AS emission, round(CASE WHEN beta IS NULL THEN NULL WHEN event_type = 'view' THEN -60 ELSE greatest(-100, -ln(beta) - abs(k * 9 - speed_kmh) / beta) END, 6) AS transition FROM b"""


@query(ADAPTIVE)
def adaptive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation, scale and log weights of the adaptive matching model; the clock is slowed by an irrational factor, so that no value lies between two roundings."""
    w = T.along()
    rows = T.steps_since_anchor(telemetry(spark, sf_dir)).withColumns({"was": F.lag("speed_kmh").over(w), "dr0": F.lag("is_dr").over(w), "dt": F.greatest(F.lit(0.1), (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000.0)})
    sigma = L.adaptive_sigma(F.col("accuracy_m") - 30, F.col("is_dr"), F.col("dr_step"))
    beta = F.when(F.col("was").isNotNull(), L.dynamic_beta(F.greatest("speed_kmh", "was") / 3.6, F.col("dt") / (1000 * F.pi()), F.col("is_dr") | F.col("dr0")))
    route = F.when(F.col("event_type") != "view", F.col("k") * 9)
    scaled = rows.withColumns({"sigma": sigma, "beta": beta})
    return rounded(scaled.select("session_id", "seq", "sigma", "beta", L.adaptive_emission(F.col("k"), F.col("sigma")).alias("emission"), F.when(F.col("beta").isNotNull(), L.dynamic_transition(route, F.col("speed_kmh"), F.col("beta"))).alias("transition")), 6)


# --- exports ---------------------------------------------------------------------------------------


def _fixed(x: str, places: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE printf('%.{places}f', round({x}, {places})) END"


def _export_sql() -> str:
    blank = "''"
    cells = ["CAST(t_ms AS VARCHAR)", "strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')", "CASE WHEN off THEN 'DEAD_RECKONING' ELSE 'GNSS' END", _fixed("lat", 6), _fixed("lng", 6), _fixed("accuracy_m", 1), _fixed("speed_kmh", 1), _fixed("h", 1), blank, "CASE WHEN off THEN 'TRUE' ELSE 'FALSE' END", _fixed("va", 6), blank, _fixed("speed_kmh", 2), blank, "CASE WHEN event_type = 'view' THEN 'ARMED' WHEN speed_kmh > 0.5 THEN 'RELEASED' ELSE 'LOCKED' END", "CASE WHEN gnss_rejected THEN 'TRUE' ELSE 'FALSE' END", "'FALSE'", _fixed("cb", 6), _fixed("cb2", 6), *[blank] * 3, "CAST(t_ms - 250 AS VARCHAR)", "'FALSE'", *[blank] * 5, _fixed("cb", 6), _fixed("cb2", 6), blank, blank]
    return SPANS + ", e AS (SELECT *, k * 3.5 AS h, k / 128 AS va, CASE WHEN NOT is_dr THEN lat END AS cb, CASE WHEN NOT is_dr THEN lng END AS cb2 FROM o) SELECT session_id, seq, " + " || ',' || ".join(cells) + " AS line FROM e"


@query(_export_sql())
def telemetry_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in the 33 columns of the export."""
    fix = ~F.col("is_dr")
    rows = telemetry(spark, sf_dir).withColumns({"gnss_rejected": _rejected(), "heading_deg": F.col("k") * 3.5, "var_a": F.col("k") / 128, "raw_speed_kmh": F.col("speed_kmh"), "zupt_state": F.when(F.col("event_type") == "view", "ARMED"), "cb_lat": F.when(fix, F.col("lat")), "cb_lng": F.when(fix, F.col("lng")), "cb_t_ms": F.col("t_ms") - 250})
    cells = P.telemetry_export(rows, keep=("session_id", "seq"))
    return cells.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.concat_ws(",", *(n for n, _, _ in P.EXPORT)).alias("line"))


def _tick_sql() -> str:
    zero = "'0.0000'"
    cells = ["CAST(t_ms AS VARCHAR)", _fixed("k / 64", 4), zero, "'9.8100'", *[zero] * 3, _fixed("g1", 8), _fixed("g2", 8), _fixed("g3", 2), _fixed("lat", 8), _fixed("lng", 8), _fixed("speed_kmh", 4), zero, zero, _fixed("k * 3.5", 2), "CASE WHEN is_dr THEN 'IDR' ELSE 'GNSS' END", "CASE WHEN accuracy_m > 25 THEN 'WEAK_LOST' WHEN accuracy_m > 10 THEN 'DEGRADED' ELSE 'GOOD' END", "''", "''"]
    return f"WITH {TELEMETRY}, e AS (SELECT *, CASE WHEN NOT is_dr THEN lat END AS g1, CASE WHEN NOT is_dr THEN lng END AS g2, CASE WHEN NOT is_dr THEN accuracy_m END AS g3 FROM tel) SELECT " + " || ',' || ".join(cells) + " AS line FROM e"


@query(_tick_sql())
def tick_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix, zero, none = ~F.col("is_dr"), F.lit(0.0), F.lit(None).cast("double")
    rows = telemetry(spark, sf_dir).withColumns({"timestamp": F.col("t_ms"), "accel_x": F.col("k") / 64, "accel_y": zero, "accel_z": F.lit(9.81), "gyro_x": zero, "gyro_y": zero, "gyro_z": zero, "gnss_lat": F.when(fix, F.col("lat")), "gnss_lng": F.when(fix, F.col("lng")), "gnss_accuracy": F.when(fix, F.col("accuracy_m")), "vel_x": F.col("speed_kmh"), "vel_y": zero, "vel_z": zero, "heading": F.col("k") * 3.5, "source_mode": F.when(fix, "GNSS").otherwise("IDR"), "gnss_state": L.simple_gnss_state(F.col("accuracy_m")), "pure_ins_lat": none, "pure_ins_lng": none})
    return P.tick_log(rows)


# --- live checks -----------------------------------------------------------------------------------


@query(f"""WITH {TELEMETRY}, a AS (SELECT session_id, seq, (t_ms - max(CASE WHEN NOT is_dr THEN t_ms END) OVER (PARTITION BY session_id ORDER BY seq)) / 1000.0 AS age FROM (SELECT * REPLACE (t_ms // 1000 AS t_ms) FROM tel)) SELECT session_id, seq, round(age, 6) AS age_s, coalesce(round(age) > 10, false) AS stale, coalesce(age < 2.5, false) AS speed_fresh, coalesce(age < 6, false) AS source_fresh FROM a""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand steps of the clock count as one."""
    rows = telemetry(spark, sf_dir).withColumn("t", (F.col("t_ms") / 1000).cast("long"))
    return rounded(T.staleness(rows, time="t").select("session_id", "seq", "age_s", "stale", "speed_fresh", "source_fresh"))


@query(f"""WITH {TELEMETRY}, a AS (SELECT session_id, seq, CASE WHEN event_type = 'signup' AND seq % 40 > 30 THEN -t_ms ELSE seq * 100 END AS t, seq // 20 AS x, k * 0 AS y FROM tel), b AS (SELECT *, x = lag(x) OVER w AND y = lag(y) OVER w AS same, t - lag(t) OVER w AS dt, lag(t) OVER w AS was FROM a WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
c AS (SELECT *, seq - coalesce(max(CASE WHEN NOT coalesce(same, false) THEN seq END) OVER (PARTITION BY session_id ORDER BY seq), 0) AS n FROM b) SELECT session_id, seq, n >= 15 AS frozen, coalesce(was > 0 AND (dt < 0 OR dt > 10000), false) AS clock, CASE WHEN n >= 15 THEN 'HIGH' WHEN was > 0 AND (dt < 0 OR dt > 10000) THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM c""")
def imu_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor that changes its value every twenty samples, and a clock that leaps."""
    leaps = (F.col("event_type") == "signup") & (F.col("seq") % 40 > 30)
    rows = telemetry(spark, sf_dir).select("session_id", "seq", F.when(leaps, -F.col("t_ms")).otherwise(F.col("seq") * 100).alias("t"), F.expr("seq div 20").alias("x"), (F.col("k") * 0).alias("y"))
    return T.imu_anomalies(rows, ["x", "y"], time="t").select("session_id", "seq", "frozen", "clock", "severity")


@query(f"""WITH {TELEMETRY}, a AS (SELECT *, last(CASE WHEN is_dr THEN struct_pack(v := k, c := speed_kmh / 500) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS held FROM tel) SELECT session_id, seq, CASE WHEN accuracy_m > 10 AND held.c >= 0.05 THEN held.v END AS correction FROM a""")
def held_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", F.when(F.col("is_dr"), F.col("k")).alias("v"), (F.col("speed_kmh") / 500).alias("c"), L.simple_gnss_state(F.col("accuracy_m")).alias("state"))
    return T.held_correction(rows, "v", "c", "state", "correction").select("session_id", "seq", "correction")


@query(f"""WITH {TELEMETRY}, m AS (SELECT 'raw' AS method, session_id, avg(k) AS drift_pct FROM tel GROUP BY session_id UNION ALL SELECT 'filter', session_id, CASE WHEN min(k) < 1 THEN CAST('infinity' AS DOUBLE) ELSE avg(k) * 0.5 + min(speed_kmh) / 10 END FROM tel GROUP BY session_id), s AS (SELECT method, count(*) AS n_sessions, avg(drift_pct) AS mean_drift, median(drift_pct) AS median_drift FROM m WHERE drift_pct < 1e6 GROUP BY method)
SELECT method, n_sessions, round(mean_drift, 6) AS mean_drift, round(median_drift, 6) AS median_drift, round(100 * (1 - mean_drift / (SELECT mean_drift FROM s WHERE method = 'raw')), 6) AS gain_pct FROM s""")
def compared_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = telemetry(spark, sf_dir).groupBy("session_id").agg(F.avg("k").alias("raw"), F.when(F.min("k") < 1, float("inf")).otherwise(F.avg("k") * 0.5 + F.min("speed_kmh") / 10).alias("filter"))
    return rounded(T.compared_methods(by.unpivot("session_id", ["raw", "filter"], "method", "drift_pct"), "raw"))


@query(f"""WITH {TELEMETRY}, m AS (SELECT session_id, sqrt(k * k + speed_kmh * speed_kmh + 1) AS a, sqrt(k * k + 2) AS g, abs(speed_kmh) AS h FROM tel) SELECT session_id, {", ".join(f"round({f}({c}), 6) AS {p}_{n}" for c, n in (("a", "accel"), ("g", "gyro"), ("h", "grav")) for p, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")))} FROM m GROUP BY session_id""")
def magnitude_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumns({"one": F.lit(1.0), "zero": F.lit(0.0)})
    return rounded(T.magnitude_statistics(rows, {"accel": ["k", "speed_kmh", "one"], "gyro": ["k", "one", "one"], "grav": ["speed_kmh", "zero", "zero"]}))


# --- roads and routes ------------------------------------------------------------------------------


@query(f"""WITH {ROADS} SELECT CASE WHEN from_node % 3 = 0 THEN CAST(edge_id AS VARCHAR) WHEN from_node % 3 = 1 THEN CAST(edge_id + 1 AS VARCHAR) ELSE CAST(from_node AS VARCHAR) || '_' || CAST(to_node AS VARCHAR) || '_0' END AS edge_id, from_node, to_node, round(lat1, 6) AS lat1, round(lng2, 6) AS lng2, from_node % 2 = 0 AS oneway, CASE WHEN from_node % 3 = 0 THEN 'Main' WHEN from_node % 3 = 1 THEN 'First' ELSE '' END AS name FROM segments""")
def graph_edges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with plain, list-valued and missing ids and names."""
    s, third = road_segments(spark, sf_dir), F.col("from_node") % 3
    ids = F.when(third == 0, F.col("edge_id").cast("string")).when(third == 1, F.format_string("[%d, 7]", F.col("edge_id") + 1))
    names = F.when(third == 0, "Main").when(third == 1, '["First", "Second"]')
    edges = s.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.lit(0).alias("key"), ids.alias("osmid"), names.alias("name"), F.when(F.col("from_node") % 2 == 0, F.lit(True)).alias("oneway"))
    return rounded(graph_edges(edges, road_nodes(spark, sf_dir)).select("edge_id", "from_node", "to_node", "lat1", "lng2", "oneway", "name"))


def _routing_answers(spark: SparkSession, sf_dir: str, summary: Column | None = None) -> DataFrame:
    """A saved answer for each order, of one route with two legs of one and two steps; the first leg has the summary, if one is given."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    kinds = ("depart", "turn", "arrive", "new name", "continue", "merge", "fork", "roundabout", "on ramp", "off ramp", "notify")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (key % 11 + 1).cast("int"))

    def step(i: int) -> Column:
        street = F.when((key + i) % 3 != 0, F.concat(F.lit("Street "), (key % 5).cast("string")))
        return F.struct(F.struct(kind.alias("type"), F.lit(None if i == 1 else "left").cast("string").alias("modifier")).alias("maneuver"), street.alias("name"), (price / 10 * (i + 1)).alias("distance"), (price / 100 * (i + 1)).alias("duration"))

    told = F.lit(None).cast("string") if summary is None else summary
    legs = F.array(F.struct(told.alias("summary"), F.array(step(0)).alias("steps")), F.struct(F.lit(None).cast("string").alias("summary"), F.array(step(1), step(2)).alias("steps")))
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), F.to_json(F.struct(F.array(F.struct(legs.alias("legs"))).alias("routes"))).alias("body"))


@query("""WITH o AS (SELECT o_orderkey AS request_id, CAST(range AS BIGINT) AS step, o_orderkey % 11 AS q, range AS i, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN (o_orderkey + range) % 3 = 0 THEN NULL ELSE 'Street ' || CAST(o_orderkey % 5 AS VARCHAR) END AS street FROM orders, range(3)),
k AS (SELECT *, ['depart', 'turn', 'arrive', 'new name', 'continue', 'merge', 'fork', 'roundabout', 'on ramp', 'off ramp', 'notify'][CAST(q AS INT) + 1] AS kind, CASE WHEN i = 1 THEN NULL ELSE 'left' END AS m, CASE WHEN street IS NULL THEN '' ELSE 'onto ' || street END AS onto, CASE WHEN i = 1 THEN '' ELSE ' left' END AS tm FROM o)
SELECT request_id, CAST(0 AS BIGINT) AS option, step, kind, coalesce(street, 'Unnamed Street') AS street, CAST(floor(price / 10 * (i + 1) + 0.5) AS BIGINT) AS distance_m, CAST(floor(price / 100 * (i + 1) + 0.5) AS BIGINT) AS duration_s,
trim(CASE kind WHEN 'depart' THEN CASE WHEN street IS NULL THEN 'Head out towards destination' ELSE 'Depart on ' || street END WHEN 'arrive' THEN 'Arrive at destination' WHEN 'turn' THEN 'Turn' || tm || ' ' || onto WHEN 'new name' THEN 'Continue ' || onto WHEN 'continue' THEN 'Continue straight ' || onto WHEN 'merge' THEN 'Merge' || tm || ' ' || onto WHEN 'fork' THEN 'Keep' || tm || ' at fork ' || onto WHEN 'roundabout' THEN 'Enter roundabout and take exit ' || onto WHEN 'on ramp' THEN 'Take ramp ' || onto WHEN 'off ramp' THEN 'Take exit ' || onto ELSE kind || tm || ' ' || onto END) AS instruction FROM k""")
def route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_steps(_routing_answers(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS request_id, CAST(range AS BIGINT) AS step, o_orderkey % 11 AS q, CASE WHEN (o_orderkey + range) % 3 = 0 THEN 'path' ELSE 'Street ' || CAST(o_orderkey % 5 AS VARCHAR) END AS street, range <> 1 AS turns FROM orders, range(3))
SELECT request_id, step, CASE q WHEN 0 THEN 'Head out cycling on ' || street WHEN 1 THEN CASE WHEN turns THEN 'Turn left onto ' ELSE 'Turn ahead onto ' END || street WHEN 2 THEN 'Arrive at destination (' || street || ')' WHEN 3 THEN 'new name onto ' || street WHEN 4 THEN 'Continue on ' || street WHEN 5 THEN 'merge onto ' || street WHEN 6 THEN CASE WHEN turns THEN 'Take the left fork onto ' ELSE 'Take the slight fork onto ' END || street WHEN 7 THEN 'Enter roundabout and take exit onto ' || street WHEN 8 THEN 'on ramp onto ' || street WHEN 9 THEN 'off ramp onto ' || street ELSE 'notify onto ' || street END AS instruction FROM o""")
def vehicle_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps in the words for a bike."""
    return R.route_steps(_routing_answers(spark, sf_dir), vehicle="bike").select("request_id", "step", "instruction")


@query("""SELECT o_orderkey AS request_id, CAST(0 AS BIGINT) AS option, CASE o_orderkey % 4 WHEN 0 THEN 'Main, High' ELSE 'Via ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Unnamed Street' ELSE 'Street ' || CAST(o_orderkey % 5 AS VARCHAR) END END AS summary FROM orders""")
def route_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("o_orderkey") % 4 == 0, "Main, High").when(F.col("o_orderkey") % 4 == 1, "")
    return R.route_summaries(_routing_answers(spark, sf_dir, told))
