"""Telemetry seen in the `events` table, and a road lattice over the same area seen in `orders`; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: South-west corner of the lattice, its nodes from west to east, and their distance in degrees.
LAT0, LNG0, SIDE, STEP = 17.63, 75.87, 41, 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: a user is a session, an error is dead reckoning, value is the speed."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    k = F.get_json_object("props", "$.k").cast("double")
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    return e.select(
        "session_id",
        F.row_number().over(order).cast("long").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        F.col("value").alias("speed_kmh"),
        k.alias("k"),
        (1 + k).alias("accuracy_m"),
        (F.col("event_type") == "error").alias("is_dr"),
        (LAT0 + F.col("value") / 490 * 0.02).alias("lat"),
        (LNG0 + k / 100 * 0.04).alias("lng"),
        "event_type",
    )


TELEMETRY = f"""tel AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS t_ms, value AS speed_kmh,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS accuracy_m, event_type = 'error' AS is_dr,
  CAST({LAT0} AS DOUBLE) + value / 490 * 0.02 AS lat, CAST({LNG0} AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 * 0.04 AS lng, event_type FROM events)"""


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crossing for each order, in rows of SIDE from south to north: the lattice grows northwards with the table."""
    key = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(key.alias("node_id"), F.expr(f"o_orderkey div {SIDE}").alias("row"), (key % SIDE).alias("col"))
    return cells.withColumns({"lat": LAT0 + F.col("row") * STEP, "lng": LNG0 + F.col("col") * STEP})


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point streets between neighbouring nodes; every seventh row of streets is left out."""
    n = road_nodes(spark, sf_dir)
    east = n.where((F.col("col") < SIDE - 1) & (F.col("row") % 7 != 3)).select("node_id", "lat", "lng", (F.col("node_id") + 1).alias("to_node"), F.lit("residential").alias("road_type"))
    north = n.where(F.col("col") % 5 != 2).select("node_id", "lat", "lng", (F.col("node_id") + SIDE).alias("to_node"), F.lit("primary").alias("road_type"))
    ends = n.select(F.col("node_id").alias("to_node"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    both = east.union(north).join(ends, "to_node")
    return both.select((F.col("node_id") * 10000 + F.col("to_node")).alias("edge_id"), F.col("node_id").alias("from_node"), "to_node", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "lat2", "lng2", "road_type")


def both_ways(streets: DataFrame) -> DataFrame:
    """Streets with a reversed twin of each, whose id is the negative one."""
    twins = streets.select((-F.col("edge_id")).alias("edge_id"), F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), F.col("lat2").alias("lat1"), F.col("lng2").alias("lng1"), F.col("lat1").alias("lat2"), F.col("lng1").alias("lng2"), "road_type")
    return streets.unionByName(twins)


ROADS = f"""nodes AS (SELECT o_orderkey AS node_id, o_orderkey // {SIDE} AS "row", o_orderkey % {SIDE} AS col, CAST({LAT0} AS DOUBLE) + (o_orderkey // {SIDE}) * CAST({STEP} AS DOUBLE) AS lat, CAST({LNG0} AS DOUBLE) + (o_orderkey % {SIDE}) * CAST({STEP} AS DOUBLE) AS lng FROM orders),
segments AS (SELECT a.node_id * 10000 + b.node_id AS edge_id, a.node_id AS from_node, b.node_id AS to_node, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2, road_type
  FROM (SELECT *, node_id + 1 AS t, 'residential' AS road_type FROM nodes WHERE col < {SIDE - 1} AND "row" % 7 <> 3 UNION ALL SELECT *, node_id + {SIDE}, 'primary' FROM nodes WHERE col % 5 <> 2) a JOIN nodes b ON b.node_id = a.t)"""
#: The same with reversed twins.
TWO_WAY = f"{ROADS}, streets AS (SELECT * FROM segments UNION ALL SELECT -edge_id, to_node, from_node, lat2, lng2, lat1, lng1, road_type FROM segments)"
