"""Queries of the persistence, road, window and fold operators, with their SQL where there is one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geodesy as G
from waymark.functions import labels as L
from waymark.operators import estimators as E
from waymark.operators import matching as M
from waymark.operators import persistence as P
from waymark.operators import roads as R
from waymark.operators import routes as V
from waymark.operators import scans as C
from waymark.operators import training as D
from waymark.operators import trips as T
from waymark.plans.adapter import LAT0, LNG0, ROADS, SIDE, STEP, TELEMETRY, TWO_WAY, both_ways, road_nodes, road_segments, table, telemetry
from waymark.plans.trip_queries import BASE, hav, rounded
from waymark.sources.files import overpass_nodes, overpass_ways, pair_sessions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- persistence -----------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("start"), F.col("o_totalprice").cast("double").alias("distance"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS start, CAST(o_totalprice AS DOUBLE) AS distance FROM orders), a AS (SELECT * FROM o WHERE id % 3 <> 0), b AS (SELECT id, 'new' AS start, distance * 2 AS distance FROM o WHERE id % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.start ELSE a.start END AS start, round(CASE WHEN b.id IS NOT NULL THEN b.distance ELSE a.distance END, 2) AS distance FROM a FULL JOIN b ON a.id = b.id""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    new = o.where("id % 2 = 0").select("id", F.lit("new").alias("start"), (F.col("distance") * 2).alias("distance"))
    return rounded(P.upsert(o.where("id % 3 <> 0"), new, "id", ["distance"]), 2)


@query(f"""WITH {TELEMETRY} SELECT CASE WHEN session_id % 4 <> 0 THEN session_id END AS session_id, seq FROM tel""")
def points_without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    return P.without_orphans(tel.select("session_id", "seq"), tel.select("session_id").distinct().where("session_id % 4 <> 0"))


@query(f"""WITH {TELEMETRY} SELECT session_id, seq, min(t_ms) AS t_ms FROM tel GROUP BY session_id, seq""")
def points_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir).select("session_id", "seq", "t_ms")
    return P.first_of(tel.unionByName(tel), ["session_id", "seq"], [F.col("t_ms")])


@query(f"""WITH {TELEMETRY} SELECT session_id, count(*) FILTER (NOT is_dr) AS n_points, coalesce(string_agg(CAST(CASE WHEN NOT is_dr THEN seq END AS VARCHAR), ',' ORDER BY seq), '') AS points FROM tel GROUP BY session_id""")
def session_with_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    joined = P.with_points(tel.select("session_id").distinct(), tel.where("NOT is_dr"), "session_id", "seq", ["lat"])
    return joined.select("session_id", F.size("points").cast("long").alias("n_points"), F.concat_ws(",", F.transform("points", lambda p: p["seq"].cast("string"))).alias("points"))


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most recent; the limit is the feature."""
    return P.recent(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("created")), "created", "id")


@query("""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '1-URGENT' END AS profile, o_custkey AS coordinates, max_by(o_orderstatus, o_orderkey) AS payload, max(o_orderkey) AS written FROM orders GROUP BY 1, 2""")
def route_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("profile"), F.col("o_custkey").alias("coordinates"), F.col("o_orderstatus").alias("payload"), F.col("o_orderkey").alias("written"))
    return P.latest_routes(o, ["1-URGENT", "2-HIGH"], "1-URGENT", ["coordinates"], "written", "payload")


@query(f"""WITH {TELEMETRY} SELECT session_id, seq, k * 86400000 / 4 > 1209600000 AS stale, k * 86400000 / 4 <= 1209600000 OR is_dr AS served FROM tel""")
def road_cell_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cached_cells(telemetry(spark, sf_dir), F.col("k") * 86400000 / 4, ~F.col("is_dr")).select("session_id", "seq", "stale", "served")


@query(f"""WITH {TELEMETRY} SELECT session_id, seq, CASE WHEN k < 20 OR seq % 7 = 0 THEN 'quarantined' ELSE 'stored' END AS place FROM tel""")
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", F.when(F.col("k") >= 20, F.col("lat")).alias("lat"), F.when(F.col("seq") % 7 != 0, "a name").otherwise("").alias("name"))
    good, bad = P.split_valid(rows, ["lat", "name"])
    return good.select("session_id", "seq", F.lit("stored").alias("place")).union(bad.select("session_id", "seq", F.lit("quarantined")))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def poi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.poi_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "AR")


@query(f"""WITH {TELEMETRY} SELECT CAST(session_id AS VARCHAR) || ',' || CAST(t_ms AS VARCHAR) || ',' || printf('%.1f', round(speed_kmh, 1)) || ',' || CASE WHEN is_dr THEN 'TRUE' ELSE 'FALSE' END || ',' || CASE WHEN k < 10 THEN '' ELSE printf('%.0f', k) END || ',' || CASE WHEN is_dr THEN 'DEAD_RECKONING' ELSE 'GNSS' END || ',' || CASE WHEN speed_kmh > 0.5 THEN 'RELEASED' ELSE 'LOCKED' END AS line FROM tel""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumns({"k": F.when(F.col("k") >= 10, F.col("k")).otherwise(float("nan")), "source": F.when(F.col("is_dr"), "DEAD_RECKONING").otherwise("GNSS"), "zupt": F.when(F.col("speed_kmh") > 0.5, "RELEASED").otherwise("LOCKED")})
    return P.csv_lines(rows, [("session_id", None), ("t_ms", None), ("speed_kmh", 1), ("is_dr", None), ("k", 0), ("source", None), ("zupt", None)])


@query(f"""WITH {TELEMETRY} SELECT session_id, count(*) AS n_points, '{{"type":"LineString","coordinates":[' || string_agg('[' || CAST(CAST(k AS INT) AS VARCHAR) || ',' || CAST(seq AS VARCHAR) || ']', ',' ORDER BY seq) || ']}}' AS geometry FROM tel WHERE is_dr GROUP BY session_id""")
def span_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).where("is_dr").select("session_id", "seq", F.col("k").cast("int").alias("x"), F.col("seq").cast("int").alias("y"))
    return P.span_geojson(rows, ["session_id"], "seq", "y", "x")


@query("""WITH f AS (SELECT s_name AS n, s_suppkey AS k FROM supplier) SELECT n AS session, 'cat' || CAST(k % 3 AS VARCHAR) AS category, '/cat' || CAST(k % 3 AS VARCHAR) || '/d' || CAST(k AS VARCHAR) || '/S-' || n || '.csv' AS s_path,
'/cat' || CAST(k % 3 AS VARCHAR) || '/d' || CAST(k AS VARCHAR) || '/V-' || CASE WHEN k % 3 = 0 THEN n WHEN k % 3 = 1 THEN upper(n) ELSE 'other' END || '.csv' AS v_path FROM f""")
def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_name")
    folder = F.concat(F.lit("/cat"), (k % 3).cast("string"), F.lit("/d"), k.cast("string"))
    partner = F.when(k % 3 == 0, n).when(k % 3 == 1, F.upper(n)).otherwise(F.lit("other"))
    suppliers = table(spark, sf_dir, "supplier")
    return pair_sessions(suppliers.select(F.concat(folder, F.lit("/S-"), n, F.lit(".csv")).alias("path")).union(suppliers.select(F.concat(folder, F.lit("/V-"), partner, F.lit(".csv")))))


# --- roads -----------------------------------------------------------------------------------------


#: Rows of the lattice in one saved answer, and of a way across.
BLOCK = 40


def _answers(spark: SparkSession, sf_dir: str, geometry: bool) -> DataFrame:
    """A saved answer for each 40 rows of the lattice: a way along each row and, every fifth column, one across."""
    nodes = road_nodes(spark, sf_dir).withColumn("part", F.expr(f"`row` div {BLOCK}"))
    point = F.struct(F.col("lat").alias("lat"), F.col("lng").alias("lon"))

    def ways(keys: list[str], at: str, number: Column, oneway: str) -> DataFrame:
        line = nodes.groupBy("part", *keys).agg(F.array_sort(F.collect_list(F.struct(at, "node_id", point.alias("g")))).alias("p"))
        return line.select("part", F.lit("way").alias("type"), number.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.transform("p", lambda x: x["node_id"]).alias("nodes"), F.transform("p", lambda x: x["g"]).alias("geometry"), F.create_map(F.lit("highway"), F.lit("residential"), F.lit("oneway"), F.when(F.col(oneway) % 2 == 0, "yes").otherwise("no")).alias("tags"))

    every = ways(["row"], "col", F.col("row"), "row").union(ways(["col"], "row", -(1 + F.col("col") + SIDE * F.col("part")), "col").where(f"(-id - 1) % {SIDE} % 5 = 0"))
    if not geometry:
        empty = every.schema
        single = nodes.select("part", F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", F.col("lng").alias("lon"), F.lit(None).cast(empty["nodes"].dataType).alias("nodes"), F.lit(None).cast(empty["geometry"].dataType).alias("geometry"), F.lit(None).cast(empty["tags"].dataType).alias("tags"))
        every = every.union(single)
    return every.groupBy("part").agg(F.collect_list(F.struct(*every.columns[1:])).alias("elements")).select(F.to_json(F.struct("elements")).alias("body"))


WAYS = f"""{ROADS}, wp AS (SELECT CAST("row" AS BIGINT) AS way_id, "row" % 2 = 0 AS oneway, col AS pos, node_id, lat, lng FROM nodes UNION ALL SELECT -(1 + col + {SIDE} * ("row" // {BLOCK})), col % 2 = 0, "row" % {BLOCK}, node_id, lat, lng FROM nodes WHERE col % 5 = 0)"""
CUTS = f"""{WAYS}, u AS (SELECT node_id, count(*) AS uses FROM wp GROUP BY node_id), c AS (SELECT wp.*, uses >= 2 OR pos = 0 OR pos = max(pos) OVER (PARTITION BY way_id) AS is_cut FROM wp JOIN u USING (node_id)), k AS (SELECT *, lead(pos) OVER (PARTITION BY way_id ORDER BY pos) AS next_at, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS next_node FROM c WHERE is_cut),
seg AS (SELECT wp.*, lead(lat) OVER w AS lat0, lead(lng) OVER w AS lng0 FROM wp WINDOW w AS (PARTITION BY way_id ORDER BY pos)), len AS (SELECT k.way_id, k.oneway, k.node_id AS a, k.next_node AS b, k.next_at - k.pos + 1 AS n_points, sum({hav("seg.lat", "seg.lng", "seg.lat0", "seg.lng0")}) AS length_m FROM k JOIN seg ON seg.way_id = k.way_id AND seg.pos >= k.pos AND seg.pos < k.next_at WHERE k.next_at IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {CUTS} SELECT way_id || '_' || a || '_' || b AS edge_id, a AS from_node, b AS to_node, CAST(n_points AS BIGINT) AS n_points, round(length_m, 4) AS length_m FROM len UNION ALL SELECT way_id || '_' || a || '_' || b || '_rev', b, a, CAST(n_points AS BIGINT), round(length_m, 4) FROM len WHERE NOT oneway""".replace("GROUP BY ALL", "GROUP BY k.way_id, k.oneway, k.node_id, k.next_node, k.next_at, k.pos"))
def junction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.junction_edges(overpass_ways(_answers(spark, sf_dir, True))).select("edge_id", "from_node", "to_node", "n_points", "length_m"), 4)


@query(f"""WITH {WAYS}, s AS (SELECT *, lead(lat) OVER w AS lat0, lead(lng) OVER w AS lng0 FROM wp WINDOW w AS (PARTITION BY way_id ORDER BY pos)) SELECT way_id, CAST(pos AS BIGINT) AS at, round({hav("lat", "lng", "lat0", "lng0")}, 4) AS length_m FROM s WHERE lat0 IS NOT NULL""")
def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways, nodes = overpass_nodes(_answers(spark, sf_dir, False))
    return rounded(R.way_segments(ways, nodes, ["footway", "steps", "pedestrian", "path", "cycleway"]).select("way_id", "at", "length_m"), 4)


@query(f"""WITH {ROADS} SELECT node_id, count(*) AS degree FROM (SELECT from_node AS node_id FROM segments UNION ALL SELECT to_node FROM segments) GROUP BY node_id""")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.node_degrees(road_segments(spark, sf_dir))


@query(f"""WITH RECURSIVE {ROADS}, e AS (SELECT from_node AS a, to_node AS b FROM segments WHERE road_type = 'primary' UNION ALL SELECT to_node, from_node FROM segments WHERE road_type = 'primary'), reach(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT n, b FROM reach JOIN e ON m = a) SELECT n AS node_id, min(m) AS component FROM reach GROUP BY n""")
def road_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(road_segments(spark, sf_dir).where("road_type = 'primary'"))


@query(f"""WITH {ROADS} SELECT edge_id, CASE WHEN from_node % 2 = 0 THEN 1 ELSE 2 END AS cell_order FROM segments""".replace("1 ELSE 2 END", "CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END"))
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = road_segments(spark, sf_dir).select("edge_id", "from_node")
    cells = [s.where("from_node % 2 = 0").withColumn("cell_order", F.lit(1).cast("long")), s.withColumn("cell_order", F.lit(2).cast("long"))]
    return R.merged_edges(cells).select("edge_id", "cell_order")


def _metres_to_segment() -> str:
    r = G.RADIUS_MEAN
    ax, ay, bx, by = (f"({r} * radians({a}) * {b})" for a, b in (("lng1 - lng", "cos(radians(lat))"), ("lat1 - lat", "1"), ("lng2 - lng", "cos(radians(lat))"), ("lat2 - lat", "1")))
    share = f"greatest(0, least(1, (-{ax} * ({bx} - {ax}) - {ay} * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({ax} + {share} * ({bx} - {ax}), 2) + pow({ay} + {share} * ({by} - {ay}), 2))"


NEAR = f"WITH {TELEMETRY}, {ROADS}, d AS (SELECT session_id, seq, lat, lng, accuracy_m, edge_id, {_metres_to_segment()} AS distance FROM tel, segments WHERE abs(lat1 - lat) < 0.002 AND abs(lng1 - lng) < 0.002)"


@query(NEAR + """ SELECT session_id, seq, edge_id, CAST(row_number() OVER w AS BIGINT) AS rank, round(distance, 4) AS distance_m, round(-ln(sqrt(2 * pi()) * s) - 0.5 * pow(distance / s, 2), 4) AS emission FROM (SELECT *, CASE WHEN accuracy_m > 1 THEN greatest(2, least(accuracy_m, 30)) ELSE 4.07 END AS s FROM d WHERE distance <= 50) WINDOW w AS (PARTITION BY session_id, seq ORDER BY round(distance, 6), edge_id) QUALIFY row_number() OVER w <= 5""")
def edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.edge_candidates(telemetry(spark, sf_dir).select("session_id", "seq", "lat", "lng", "accuracy_m"), road_segments(spark, sf_dir), keys=["session_id", "seq"])
    return rounded(found.select("session_id", "seq", "edge_id", "rank", "distance_m", L.emission(F.col("distance_m"), F.col("accuracy_m")).alias("emission")), 4)


@query(NEAR + """, b AS (SELECT session_id, seq, min_by(edge_id, struct_pack(d := round(distance, 6), e := edge_id)) AS edge_id, min(distance) AS distance FROM d WHERE distance <= 20 GROUP BY session_id, seq) SELECT tel.session_id, tel.seq, edge_id, round(distance, 4) AS distance_m FROM tel LEFT JOIN b ON tel.session_id = b.session_id AND tel.seq = b.seq""")
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = telemetry(spark, sf_dir).select("session_id", "seq", "lat", "lng", "accuracy_m")
    return rounded(R.snapped(points, road_segments(spark, sf_dir), keys=["session_id", "seq"]).select("session_id", "seq", "edge_id", "distance_m"), 4)


def _heading_snaps() -> str:
    lat1, lng1, lat2, lng2, turn = "radians(lat1)", "radians(lng1)", "radians(lat2)", "radians(lng2)", "degrees(atan2(sin({b} - {a}) * cos({d}), cos({c}) * sin({d}) - sin({c}) * cos({d}) * cos({b} - {a})))"
    along = turn.format(a=lng1, b=lng2, c=lat1, d=lat2)
    return NEAR.replace("accuracy_m, edge_id", "accuracy_m, road_type, k * 3.6 AS heading, speed_kmh / 3.6 AS speed, lat1, lng1, lat2, lng2, edge_id") + f""", h AS (SELECT *, abs(((({along} - heading + 180) % 360) + 360) % 360 - 180) AS forth FROM d WHERE distance <= 20), g AS (SELECT *, CASE WHEN road_type = 'primary' THEN forth ELSE least(forth, 180 - forth) END AS turn FROM h),
 c AS (SELECT *, distance + CASE WHEN heading IS NOT NULL AND speed > 1 THEN radians(turn) * 10 ELSE 0 END AS cost FROM g WHERE NOT coalesce(heading IS NOT NULL AND speed > 1, false) OR turn <= 45), b AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY round(cost, 6), edge_id) AS r FROM c)
 SELECT tel.session_id, tel.seq, edge_id, round(distance, 4) AS distance_m, round(coalesce(greatest(0, 1 - distance / 20), 0), 4) AS confidence FROM tel LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON tel.session_id = b.session_id AND tel.seq = b.seq"""


@query(_heading_snaps())
def live_snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = telemetry(spark, sf_dir).select("session_id", "seq", "lat", "lng", (F.col("k") * 3.6).alias("heading"), (F.col("speed_kmh") / 3.6).alias("speed"))
    streets = road_segments(spark, sf_dir).withColumn("oneway", F.col("road_type") == "primary")
    found = R.snapped(points, streets, keys=["session_id", "seq"], heading="heading", speed="speed")
    return rounded(found.select("session_id", "seq", "edge_id", "distance_m", "confidence"), 4)


@query(f"""WITH {TELEMETRY}, {ROADS}, d AS (SELECT session_id, seq, node_id, sqrt(pow(tel.lat - nodes.lat, 2) + pow(tel.lng - nodes.lng, 2)) AS degrees FROM tel, nodes WHERE abs(tel.lat - nodes.lat) < 0.002 AND abs(tel.lng - nodes.lng) < 0.002) SELECT session_id, seq, round(min(degrees), 8) AS degrees FROM d GROUP BY session_id, seq""")
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.nearest_nodes(telemetry(spark, sf_dir), road_nodes(spark, sf_dir), keys=["session_id", "seq"]).select("session_id", "seq", "degrees"), 8)


@query(f"""WITH {TELEMETRY} SELECT session_id, count(*) AS n_missing FROM tel WHERE floor(lng / 0.025) % 2 = 0 GROUP BY session_id""")
def uncovered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tel = telemetry(spark, sf_dir)
    stored = tel.where(G.cell_index(F.col("lng")) % 2 != 0).select(G.cell_key(F.col("lat"), F.col("lng")).alias("cell_key"))
    return R.uncovered_spans(tel, stored, "session_id")


@query(f"""WITH {TELEMETRY}, r AS (SELECT g AS route_id, i AS seq, {LAT0} + i * CAST(0.004 AS DOUBLE) AS lat1, {LNG0} + g * CAST(0.003 AS DOUBLE) + (i % 2) * CAST(0.02 AS DOUBLE) AS lng1 FROM range(7) h(g), range(6) t(i)), l AS (SELECT *, lead(lat1) OVER w AS lat2, lead(lng1) OVER w AS lng2 FROM r WINDOW w AS (PARTITION BY route_id ORDER BY seq)), q AS (SELECT *, {hav("lat1", "lng1", "lat2", "lng2")} AS len FROM l WHERE lat2 IS NOT NULL),
a AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM q), z AS (SELECT session_id, seq, session_id % 7 AS route_id, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN 0.00005 ELSE lat END AS lat, CASE WHEN seq % 13 = 0 THEN -0.00005 ELSE lng END AS lng FROM tel),
p AS (SELECT z.*, a.seq AS leg, lat2, lng2, after, lat1 + u * (lat2 - lat1) AS plat, lng1 + u * (lng2 - lng1) AS plng FROM z, LATERAL (SELECT *, greatest(0, least(1, ((z.lng - lng1) * (lng2 - lng1) + (z.lat - lat1) * (lat2 - lat1)) / (pow(lng2 - lng1, 2) + pow(lat2 - lat1, 2)))) AS u FROM a WHERE a.route_id = z.route_id) a WHERE z.lat IS NOT NULL AND z.lng IS NOT NULL AND (abs(z.lat) >= 1e-4 OR abs(z.lng) >= 1e-4)),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY round({hav("lat", "lng", "plat", "plng")}, 6), leg) AS r FROM p), f AS (SELECT session_id, seq, leg, {hav("plat", "plng", "lat2", "lng2")} + after AS rest, {hav("lat", "lng", "plat", "plng")} AS off FROM b WHERE r = 1 UNION ALL SELECT session_id, z.seq, 0, (SELECT sum(len) FROM q WHERE q.route_id = z.route_id), 0 FROM z WHERE lat IS NULL OR lng IS NULL OR (abs(lat) < 1e-4 AND abs(lng) < 1e-4)) SELECT session_id, seq, leg, round(rest, 4) AS remaining_m, round(off, 4) AS off_route_m, rest <= 50 AS arrived FROM f""")
def route_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = spark.range(42).select((F.col("id") % 7).alias("route_id"), F.expr("id div 7").alias("seq")).select("route_id", "seq", (LAT0 + F.col("seq") * 0.004).alias("lat"), (LNG0 + F.col("route_id") * 0.003 + (F.col("seq") % 2) * 0.02).alias("lng"))
    lost = F.col("seq") % 13 == 0
    lat, lng = F.when(F.col("seq") % 11 != 0, F.when(lost, 0.00005).otherwise(F.col("lat"))), F.when(lost, -0.00005).otherwise(F.col("lng"))
    points = telemetry(spark, sf_dir).select("session_id", "seq", lat.alias("lat"), lng.alias("lng"), (F.col("session_id") % 7).alias("route_id"))
    return rounded(R.route_remaining(points, route, ["session_id", "seq"]), 4)


@query(f"""WITH {ROADS} SELECT a.edge_id, b.edge_id AS next_edge FROM segments a JOIN segments b ON a.to_node = b.from_node""")
def out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.out_edges(road_segments(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey AS request_id, range AS option, CAST(o_totalprice AS DOUBLE) * (1 + (o_orderkey * (range + 3)) % 5) AS d, CAST(o_totalprice AS DOUBLE) / 100 * (1 + (o_orderkey * (range + 7)) % 3) AS t FROM orders, range(3)), m AS (SELECT request_id, option, floor(d / 1000 * 10 + 0.5) / 10 AS km, greatest(1, CAST(floor(t / 60 + 0.5) AS BIGINT)) AS minutes FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY minutes, option) AS f, row_number() OVER (PARTITION BY request_id ORDER BY km, option) AS s FROM m) SELECT request_id, option, round(km, 1) AS km, minutes, CASE WHEN option = 0 THEN 'Recommended' WHEN f = 1 THEN 'Fastest' WHEN s = 1 THEN 'Shortest' ELSE 'Alternative' END AS label FROM w""")
def route_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    routes = F.array(*(F.struct((price * (1 + key * (i + 3) % 5)).alias("distance"), (price / 100 * (1 + key * (i + 7) % 3)).alias("duration"), F.struct(F.array(F.array(F.lit(75.87), F.lit(17.63))).alias("coordinates")).alias("geometry")) for i in range(3)))
    answers = table(spark, sf_dir, "orders").select(key.alias("request_id"), F.to_json(F.struct(routes.alias("routes"))).alias("body"))
    return rounded(R.route_options(answers).select("request_id", "option", "km", "minutes", "label"), 1)


# --- windows ---------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("session_id", "seq", F.when(F.col("k") >= 5, F.col("k")).alias("a"), F.col("k").alias("b"), (F.col("speed_kmh") - 60).alias("err"))


WIN = f"WITH {TELEMETRY}, f AS (SELECT session_id, seq, CASE WHEN k >= 5 THEN k ELSE 0 END AS a, k AS b, CAST(speed_kmh - 60 AS FLOAT) AS err, count(*) OVER (PARTITION BY session_id) AS n FROM tel), w AS (SELECT *, sum(a) OVER x AS sum_a, sum(b) OVER x AS sum_b FROM f WINDOW x AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@query(WIN + " SELECT session_id, seq AS end_row, CAST(20 AS BIGINT) AS size, round(sum_a, 4) AS sum_a, round(sum_b, 4) AS sum_b, round(CAST(err AS DOUBLE), 3) AS target FROM w WHERE seq >= 20 AND seq < n AND (seq - 20) % 5 = 0 AND abs(err) <= 50")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.training_windows(_features(spark, sf_dir), ["a", "b"], ["a", "b"], ["err"])

    def total(i: int) -> Column:
        return F.aggregate("window", F.lit(0.0), lambda s, x: s + x[i].cast("double"))

    return w.select("session_id", "end_row", F.size("window").cast("long").alias("size"), F.round(total(0), 4).alias("sum_a"), F.round(total(1), 4).alias("sum_b"), F.round(F.col("target")[0].cast("double"), 3).alias("target"))


@query(WIN + " SELECT session_id, seq, round(CASE WHEN seq >= 20 THEN sum_a / 20 * 0.5 ELSE 0 END, 4) AS score_x, round(CASE WHEN seq >= 20 THEN sum_b / 20 * 0.25 ELSE 0 END, 4) AS score_y FROM w")
def inference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.scored(_features(spark, sf_dir), ["a", "b"], D.linear_model(np.array([[0.5, 0.0], [0.0, 0.25]])))
    return s.select("session_id", "seq", F.round(F.col("score")[0], 4).alias("score_x"), F.round(F.col("score")[1], 4).alias("score_y"))


@query(WIN + ", k AS (SELECT session_id, seq FROM w WHERE seq >= 20 AND seq < n AND (seq - 20) % 5 = 0 AND abs(err) <= 50), e AS (SELECT f.a, f.b FROM k JOIN f ON f.session_id = k.session_id AND f.seq BETWEEN k.seq - 19 AND k.seq) SELECT CAST(0 AS BIGINT) AS channel, round(avg(a), 4) AS mean, round(stddev_pop(a) + 1e-8, 4) AS deviation FROM e UNION ALL SELECT 1, round(avg(b), 4), round(stddev_pop(b) + 1e-8, 4) FROM e")
def channel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.channel_statistics(D.training_windows(_features(spark, sf_dir), ["a", "b"], ["a"], ["err"])), 4)


@query()
def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.session_split(telemetry(spark, sf_dir))


# --- folds -----------------------------------------------------------------------------------------

MACHINE = f"""WITH RECURSIVE {TELEMETRY}, q AS (SELECT session_id, seq, (CASE WHEN is_dr OR accuracy_m / 2 >= 50 THEN 0 WHEN accuracy_m / 2 <= 10 THEN 1 - 0.2 * (accuracy_m / 2 / 10) WHEN accuracy_m / 2 <= 25 THEN 0.8 - 0.6 * ((accuracy_m / 2 - 10) / 15) ELSE greatest(0, 0.2 * (1 - (accuracy_m / 2 - 25) / 25)) END) AS score FROM tel),
m(session_id, seq, mode, poor, bad, fine) AS (SELECT session_id, CAST(0 AS BIGINT), 'GOOD', 0, 0, 0 FROM (SELECT DISTINCT session_id FROM q) UNION ALL
SELECT q.session_id, q.seq, CASE WHEN score >= 0.7 THEN CASE WHEN mode = 'GOOD' OR fine + 1 >= 20 THEN 'GOOD' ELSE 'RECOVERING' END WHEN score >= 0.2 THEN CASE WHEN poor + 1 >= 5 THEN 'DEGRADED' ELSE mode END ELSE CASE WHEN bad + 1 >= 10 THEN 'LOST' ELSE mode END END,
 CASE WHEN score >= 0.7 THEN 0 WHEN score >= 0.2 THEN poor + 1 ELSE 0 END, CASE WHEN score >= 0.2 THEN 0 ELSE bad + 1 END, CASE WHEN score >= 0.7 AND mode <> 'GOOD' AND fine + 1 < 20 THEN fine + 1 ELSE 0 END FROM m JOIN q ON q.session_id = m.session_id AND q.seq = m.seq + 1)"""


def _machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "is_dr", "accuracy_m")
    return C.quality_modes(rows, ~F.col("is_dr"), F.col("accuracy_m") / 2)


@query(MACHINE + " SELECT m.session_id, m.seq, mode, round(score, 6) AS score, mode <> 'GOOD' AS ai_active, mode = 'LOST' AS skip_gnss FROM m JOIN q ON q.session_id = m.session_id AND q.seq = m.seq WHERE m.seq > 0")
def quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_machine(spark, sf_dir).drop("trust"))


@query(MACHINE + " SELECT session_id, count(*) AS n_rows, round(100 * avg(CASE WHEN mode <> 'GOOD' THEN 1 ELSE 0 END), 6) AS duty_pct FROM m WHERE seq > 0 GROUP BY session_id")
def duty_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_machine(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"), (100 * F.avg(F.col("ai_active").cast("int"))).alias("duty_pct")))


def _state() -> Column:
    return L.gnss_state(F.when(~F.col("is_dr"), F.col("k")), F.lit(None).cast("int"), F.lit(None).cast("double"))


@query()
def stabilised_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", (F.col("seq") * 1000.0).alias("t"), "lat", "lng", _state().alias("state"))
    return rounded(E.fold(rows, E.Stabiliser, ["t", "lat", "lng", "state"], E.Stabiliser.OUTPUTS), 8)


@query()
def rate_limited_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", (F.col("seq") * 1000.0).alias("t"), "lat", "lng")
    return rounded(E.fold(rows, E.RateLimiter, ["t", "lat", "lng"], E.RateLimiter.OUTPUTS), 8)


@query()
def fused_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = telemetry(spark, sf_dir).select("session_id", "seq", (~F.col("is_dr")).alias("gnss"), (F.col("speed_kmh") / 10).alias("kmh"), (k * 3.6).alias("compass"), F.when(k > 20, k * 3.5).alias("track"), F.when(k < 80, k * 3.4).alias("trajectory"), (k / 50 - 1).alias("rate"), F.lit(0.1).alias("dt"))
    return rounded(E.fold(rows, E.HeadingFusion, ["gnss", "kmh", "compass", "track", "trajectory", "rate", "dt"], E.HeadingFusion.OUTPUTS))


def _inertial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", (F.col("seq") * 0.1).alias("t"), (F.col("k") / 50 - 1).alias("ax"), (F.col("speed_kmh") / 250 - 1).alias("ay"), (F.col("k") / 500).alias("gyro"), (9.5 + F.col("k") / 100).alias("accel"), (F.col("k") * 3.6).alias("yaw"), "lat", "lng", "is_dr", "accuracy_m")
    return T.without_initial_bias(T.without_initial_bias(rows, "ax", "bx"), "ay", "by")


@query()
def inertial_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inertial(spark, sf_dir).withColumns({"nx": G.body_to_east(F.col("bx"), F.col("by"), F.col("yaw")), "ny": G.body_to_north(F.col("bx"), F.col("by"), F.col("yaw"))})
    return rounded(E.fold(rows, E.Ins, ["t", "nx", "ny", "gyro", "accel"], E.Ins.OUTPUTS))


@query()
def live_inertial_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inertial(spark, sf_dir).withColumn("dt", F.lit(0.1))
    return rounded(E.fold(rows, lambda: E.InsTracker(20), ["dt", "ax", "ay", "yaw"], E.InsTracker.OUTPUTS))


@query()
def fused_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inertial(spark, sf_dir)
    ins = E.fold(rows, E.Ins, ["t", "bx", "by", "gyro", "accel"], E.Ins.OUTPUTS, keep=("seq", "t", "lat", "lng", "is_dr", "accuracy_m"))
    lat0, lng0 = F.lit(LAT0), F.lit(LNG0)
    ready = ins.select("session_id", "seq", "t", "vel_x", "vel_y", G.east(F.col("lng"), lat0, lng0).alias("fix_x"), G.north(F.col("lat"), lat0).alias("fix_y"), (~F.col("is_dr")).alias("available"), (F.col("accuracy_m") / 2).alias("accuracy"), F.lit(8.0).alias("sats"), F.lit(0.1).alias("ai_x"), F.lit(-0.1).alias("ai_y"))
    return rounded(E.fold_together(ready, E.FusionDriver, ["t", "vel_x", "vel_y", "fix_x", "fix_y", "available", "accuracy", "sats", "ai_x", "ai_y"], E.FusionDriver.OUTPUTS, sessions=E.sessions_of(rows)))


@query(f"""WITH RECURSIVE {TELEMETRY}, e(session_id, seq, last, emitted) AS (SELECT session_id, seq, t_ms, true FROM tel WHERE seq = 1 UNION ALL SELECT t.session_id, t.seq, CASE WHEN t.t_ms - e.last >= 20000000 THEN t.t_ms ELSE e.last END, t.t_ms - e.last >= 20000000 FROM e JOIN tel t ON t.session_id = e.session_id AND t.seq = e.seq + 1) SELECT session_id, seq, emitted FROM e""")
def thinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.thinned(telemetry(spark, sf_dir).select("session_id", "seq", "t_ms"), "t_ms", 20_000_000).select("session_id", "seq", "emitted")


@query(f"""WITH RECURSIVE {TELEMETRY}, z AS (SELECT session_id, seq, t_ms, t_ms + 20000000 + (seq * 7919 + session_id * 104729) % 100000000 AS due, NOT is_dr AS ok, lead(t_ms) OVER (PARTITION BY session_id ORDER BY seq) AS after FROM tel),
e(session_id, seq, due, is_reset) AS (SELECT session_id, seq, due, coalesce(ok AND after > due, false) FROM z WHERE seq = 1 UNION ALL SELECT z.session_id, z.seq, CASE WHEN z.ok AND z.after > e.due THEN z.due ELSE e.due END, coalesce(z.ok AND z.after > e.due, false) FROM e JOIN z ON z.session_id = e.session_id AND z.seq = e.seq + 1) SELECT session_id, seq, is_reset FROM e""")
def reanchor_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets of the inertial way after intervals drawn from a hash of session and row."""
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "t_ms", (~F.col("is_dr")).alias("fix"))
    drawn = 20_000_000 + (F.col("seq") * 7919 + F.col("session_id") * 104729) % 100_000_000
    return C.reanchored(rows, "t_ms", drawn, F.col("fix")).select("session_id", "seq", "is_reset")


@query(f"""WITH RECURSIVE {TELEMETRY}, e(session_id, seq, filtered) AS (SELECT session_id, seq, CAST(speed_kmh AS DOUBLE) FROM tel WHERE seq = 1 UNION ALL SELECT t.session_id, t.seq, e.filtered + 1 / (10 * pi()) * (t.speed_kmh - e.filtered) FROM e JOIN tel t ON t.session_id = e.session_id AND t.seq = e.seq + 1) SELECT session_id, seq, round(filtered, 6) AS filtered FROM e""")
def ema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered value of each row, by an irrational factor, so that no value lies between two roundings."""
    return rounded(C.scanned(telemetry(spark, sf_dir).select("session_id", "seq", "speed_kmh"), C.Ema(1 / (10 * np.pi)), ["speed_kmh"]))


@query()
def prefetch_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("session_id", "seq", "t_ms", "lat", "lng", (F.col("speed_kmh") / 3.6).alias("v"))
    return E.fold(rows, E.PrefetchTrigger, ["t_ms", "lat", "lng", "v"], E.PrefetchTrigger.OUTPUTS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of crossings: those nearest to a row and to the next one of its session."""
    node = (F.floor((F.col("lat") - LAT0) / STEP + 0.5) * SIDE + F.floor((F.col("lng") - LNG0) / STEP + 0.5)).cast("long")
    rows = telemetry(spark, sf_dir).withColumn("source", node)
    return rows.withColumn("target", F.lead("source").over(T.along())).where("target IS NOT NULL").select("source", "target").distinct()


@query(f"""WITH RECURSIVE {TELEMETRY}, {TWO_WAY}, walked AS (SELECT floor((lat - {LAT0}) / {STEP} + 0.5) * {SIDE} + floor((lng - {LNG0}) / {STEP} + 0.5) AS source, lead(floor((lat - {LAT0}) / {STEP} + 0.5) * {SIDE} + floor((lng - {LNG0}) / {STEP} + 0.5)) OVER (PARTITION BY session_id ORDER BY seq) AS target FROM tel),
asked AS (SELECT DISTINCT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target FROM walked WHERE target IS NOT NULL),
roads AS (SELECT from_node AS a, to_node AS b, min({hav("lat1", "lng1", "lat2", "lng2")}) AS m FROM streets GROUP BY from_node, to_node),
far(source, node, metres) USING KEY (source, node) AS (SELECT source, source, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT source FROM asked)
  UNION SELECT f.source, r.b, min(f.metres + r.m) FROM far f JOIN roads r ON r.a = f.node LEFT JOIN recurring.far k ON k.source = f.source AND k.node = r.b WHERE f.metres <= 3000 AND f.metres + r.m < coalesce(k.metres, 1e300) GROUP BY f.source, r.b)
SELECT asked.source, asked.target, round(CASE WHEN asked.source = asked.target THEN 0 WHEN asked.target IN (SELECT a FROM roads) THEN metres END, 4) AS metres FROM asked LEFT JOIN far ON far.source = asked.source AND far.node = asked.target""")
def bounded_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the routes between the crossings of rows that follow each other, searched 3000 m far."""
    streets = both_ways(road_segments(spark, sf_dir))
    edges = streets.withColumn("length_m", G.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")))
    return rounded(V.bounded_routes(edges, _asked(spark, sf_dir)), 4)


@query()
def matched_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = road_segments(spark, sf_dir)
    return rounded(M.match(telemetry(spark, sf_dir), both_ways(s)), 8)


@query(BASE + """, d AS (SELECT session_id, max_by(step, seq) AS raw_error_m, avg(step) AS matched_error_m, sum(step) AS raw_progress_m, sum(step) * 0.01 * min(k) AS matched_progress_m, NOT max_by(is_dr, seq) AS anchored FROM s GROUP BY session_id)
SELECT session_id, CASE WHEN NOT anchored THEN 'kept' WHEN matched_error_m > raw_error_m + 1 THEN 'worse endpoint' WHEN raw_progress_m > 5 AND matched_progress_m < 0.7 * raw_progress_m THEN 'lost progress' ELSE 'kept' END AS verdict FROM d""")
def match_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = telemetry(spark, sf_dir).withColumn("step", T.step_distance())
    spans = walked.groupBy("session_id").agg(F.max_by("step", "seq").alias("raw_error_m"), F.avg("step").alias("matched_error_m"), F.sum("step").alias("raw_progress_m"), (F.sum("step") * 0.01 * F.min("k")).alias("matched_progress_m"), (~F.max_by("is_dr", "seq")).alias("anchored"))
    return M.do_no_harm(spans).select("session_id", "verdict")

