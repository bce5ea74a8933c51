"""Queries of the exporter's map matcher and of its parts, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import adaptive_matching as A
from waymark.operators import roads as R
from waymark.plans.adapter import ROADS, TELEMETRY, road_segments, telemetry
from waymark.plans.fleet_queries import _metres_to_segment
from waymark.plans.span_queries import _share
from waymark.plans.trip_queries import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _lines(streets: DataFrame) -> DataFrame:
    """Streets as lines of two points."""
    ends = [F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lng{i}").alias("lng")) for i in (1, 2)]
    return streets.select("edge_id", "from_node", "to_node", (F.col("road_type") == "primary").alias("oneway"), F.array(*ends).alias("points"))


def _plane() -> str:
    return f"sqrt(pow((lng2 - lng1) * {R.METRES_A_DEGREE} * cos(radians(lat)), 2) + pow((lat2 - lat1) * {R.METRES_A_DEGREE}, 2))"


WIDENED = f"""WITH {TELEMETRY}, {ROADS}, st AS (SELECT * FROM segments WHERE road_type = 'residential' AND from_node // 41 % 4 = 0), pts AS (SELECT session_id, seq, lat, lng, least(60, greatest(30, 2.5 * (4 + k / 5))) AS most FROM tel),
d AS (SELECT session_id, seq, most, edge_id, {_metres_to_segment()} AS distance, {_share()} * {_plane()} AS offset_m FROM pts, st WHERE abs(lat1 - lat) < 0.006 AND abs(lng1 - lng) < 0.003),
wide AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY round(distance, 6), edge_id) AS r FROM d WHERE distance <= 80 QUALIFY r <= 8),
own AS (SELECT session_id, seq, bool_or(distance <= most) AS close FROM wide GROUP BY session_id, seq),
found AS (SELECT w.session_id, w.seq, CASE WHEN close THEN 'radius' ELSE 'wider' END AS step, r, edge_id FROM wide w JOIN own o ON w.session_id = o.session_id AND w.seq = o.seq WHERE NOT close OR distance <= most),
lost AS (SELECT session_id, seq, 'nearest' AS step, CAST(1 AS BIGINT) AS r, edge_id FROM d WHERE seq = 1 AND NOT EXISTS (SELECT 1 FROM own WHERE own.session_id = d.session_id AND own.seq = d.seq) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(distance, 6), edge_id) = 1),
told AS (SELECT * FROM found UNION ALL SELECT * FROM lost), of AS (SELECT p.session_id, p.seq, p.lat, p.lng, max(t.seq) OVER (PARTITION BY p.session_id ORDER BY p.seq) AS source FROM pts p LEFT JOIN (SELECT DISTINCT session_id, seq FROM told) t ON t.session_id = p.session_id AND t.seq = p.seq),
every AS (SELECT o.session_id, o.seq, o.lat, o.lng, CASE WHEN o.seq = o.source THEN t.step ELSE 'projected' END AS step, row_number() OVER (PARTITION BY o.session_id, o.seq ORDER BY t.r) AS place, t.edge_id FROM of o JOIN told t ON t.session_id = o.session_id AND t.seq = o.source)
SELECT session_id, seq, step, place, e.edge_id, round({_metres_to_segment()}, 4) AS distance_m, round({_share()} * {_plane()}, 3) AS offset_m FROM every e JOIN st ON st.edge_id = e.edge_id"""


@query(WIDENED)
def widened_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all four steps, on streets of every fourth row only."""
    streets = road_segments(spark, sf_dir).where("road_type = 'residential' AND from_node div 41 % 4 = 0")
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "lat", "lng", (4 + F.col("k") / 5).alias("sigma"))
    found = A.widened_candidates(rows, _lines(streets))
    each = found.select("session_id", "seq", "step", F.posexplode("options").alias("place", "o"))
    return each.select("session_id", "seq", "step", (F.col("place") + 1).cast("long").alias("place"), "o.edge_id", F.round("o.distance_m", 4).alias("distance_m"), F.round("o.offset_m", 3).alias("offset_m"))


@query(f"""WITH {TELEMETRY}, s AS (SELECT *, is_dr AND speed_kmh < 60 AS slow, lead(is_dr AND speed_kmh < 60) OVER (PARTITION BY session_id ORDER BY seq) AS next FROM tel), k AS (SELECT * FROM s WHERE NOT (slow AND coalesce(next, false)))
SELECT tel.session_id, tel.seq, min(k.seq) AS stands, round(arg_min(k.lat, k.seq), 6) AS lat FROM tel JOIN k ON k.session_id = tel.session_id AND k.seq >= tel.seq GROUP BY tel.session_id, tel.seq""")
def expanded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of slow dead reckoning shrunk to their last row, and every row again with the row that stands for it."""
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "is_dr", "speed_kmh", "lat")
    kept = A.kept_of_runs(rows, 60.0).select("session_id", "seq", F.col("seq").alias("stands"), F.col("lat").alias("kept_lat"))
    found = A.expanded_runs(rows.select("session_id", "seq"), kept, ["stands", "kept_lat"])
    return found.select("session_id", "seq", "stands", F.round("kept_lat", 6).alias("lat"))


@query()
def adaptive_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows matched as the exporter does; tests compare it with a plain version."""
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "t_ms", "lat", "lng", "speed_kmh", (F.col("accuracy_m") / 4).alias("accuracy_m"), "is_dr")
    found = A.match_adaptive(rows, _lines(road_segments(spark, sf_dir)))
    return rounded(found.select("session_id", "seq", "matched_lat", "matched_lng", "edge_id", "step"), 8)
