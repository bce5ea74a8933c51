"""Readers of research logs, telemetry CSV and saved road answers."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.trips import unwrapped

#: Logical names of the phone log and the vehicle log and the header texts that name them.
S_COLUMNS = {"time": "TIME SINCE START", "acc_x": "ACCELEROMETER X", "acc_y": "ACCELEROMETER Y", "acc_z": "ACCELEROMETER Z", "grav_x": "GRAVITY X", "grav_y": "GRAVITY Y", "grav_z": "GRAVITY Z", "gyro_yaw": "GYROSCOPE YAW", "gyro_pitch": "GYROSCOPE PITCH", "gyro_roll": "GYROSCOPE ROLL", "orient_yaw": "ORIENTATION YAW", "orient_pitch": "ORIENTATION PITCH", "orient_roll": "ORIENTATION ROLL", "gps_lat": "LOCATION LATITUDE", "gps_lon": "LOCATION LONGITUDE", "gps_speed": "LOCATION SPEED", "gps_accuracy": "LOCATION ACCURACY", "gps_orient": "LOCATION ORIENTATION", "gps_sats": "SATELLITES IN RANGE"}
V_COLUMNS = {"time": "Time Since Start of Day (seconds)", "lat": "Latitude (degrees)", "lon": "Longitude (degrees)", "speed": "Velocity (km/hr)", "heading": "Heading (degrees)", "height": "Height (km)", "vert_vel": "Vertical velocity (km/hr)", "sample_period": "Sample period (seconds)", "yaw_rate": "Yaw Rate (deg/sec)", "veh_speed": "Indicated Vehicle Speed (km/hr)", "long_acc": "Indicated Longitudinal Acceleration (g)", "lat_acc": "Indicated Lateral Acceleration (g)", "ws_fl": "Wheel Speed Front Left (rad/sec)", "ws_fr": "Wheel Speed Front Right (rad/sec)", "ws_rl": "Wheel Speed Rear Left (rad/sec)", "ws_rr": "Wheel Speed Rear Right (rad/sec)", "gps_sats": "No of GPS Satellites Available"}
TELEMETRY_DEFAULTS = {"Accuracy_Meters": 15.0, "Speed_KmH": 0.0, "Heading_Deg": 0.0}


def resolve(columns: list[str], wanted: str) -> str:
    """The column a header text means: equal after stripping, else beginning with it, else containing it; case does not matter for the last two."""
    low = wanted.strip().lower()
    for fits in (lambda c: c.strip() == wanted.strip(), lambda c: c.strip().lower().startswith(low), lambda c: low in c.strip().lower()):
        for c in columns:
            if fits(c):
                return c
    raise KeyError(wanted)


def by_header(spark: SparkSession, path: str, comment: str | None = None) -> list[list[str]]:
    """The files under `path` (a pattern, folder or file), those with the same header line together.

    A header is a file's first line that does not begin with `comment`. The driver holds a name and
    a header for each file, as it does for any listing.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    if comment:
        lines = lines.where(~F.startswith("value", F.lit(comment)))
    firsts = lines.groupBy("file").agg(F.min_by(F.rtrim("value"), "at").alias("header")).orderBy("file").collect()
    groups: dict[str, list[str]] = {}
    for row in firsts:
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(groups.values())


def united(parts: list[DataFrame]) -> DataFrame:
    """Rows of several layouts by column name; columns a layout lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_log(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The columns of a log that it has, under their logical names, as doubles, with the file they come from and a row number in it; files may differ in their headers."""
    parts = []
    for files in by_header(spark, path):
        raw = spark.read.option("header", True).option("encoding", "iso-8859-1").csv(files)
        found = {}
        for name, header in columns.items():
            try:
                found[name] = resolve(raw.columns, header)
            except KeyError:
                continue
        parts.append(raw.select(*(F.expr(f"try_cast(trim(`{c}`) AS double)").alias(n) for n, c in found.items()), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id")))
    return united(parts).withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy("_id")).cast("long")).drop("_id")


def read_phone_log(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A phone log with its clock unwrapped; session_id is the file."""
    rows = read_log(spark, path, columns or S_COLUMNS).withColumnRenamed("file", "session_id")
    return unwrapped(rows, "time", "_t").withColumn("time", F.col("_t")).drop("_t") if "time" in rows.columns else rows


def read_vehicle_log(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A vehicle log; session_id is the file. Its clock, seconds of the day, is left as it is."""
    return read_log(spark, path, columns or V_COLUMNS).withColumnRenamed("file", "session_id")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sessions: numbers as doubles, session_id, and seq, the row number.

    Reads files `*_labeled.csv` under `path`, the session in the name, and folders `session_id=...`
    as `write_labelled` makes them; headers may differ.
    """
    top = path.rstrip("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(top)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for pattern, name in (("*_labeled.csv", r"([^/]*)_labeled\.csv$"), ("session_id=*/*.csv", r"session_id=([^/]*)/[^/]*$")):
        if not len(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, pattern))):
            continue
        for files in by_header(spark, f"{top}/{pattern}"):
            raw = spark.read.option("header", True).csv(files)
            session = F.url_decode(F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), name, 1))
            parts.append(raw.select(*(F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) for c in raw.columns if c != "seq"), session.alias("session_id"), F.monotonically_increasing_id().alias("_id")))
    if not parts:
        raise FileNotFoundError(f"no labelled sessions under {path}")
    return united(parts).withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("_id")).cast("long")).drop("_id")


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge list of a road graph: edges (u, v, key, osmid, oneway, name), of which osmid and name are JSON, and nodes (node_id, lat, lng).

    Of a list the first element counts; without osmid the id is u, v and key joined by underscores.
    A missing name is empty, a missing oneway false; edges with an unknown end are left out.
    """

    def one(c: str) -> Column:
        text = F.col(c).cast("string")
        bare = F.trim(text, F.lit('"'))
        return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.get_json_object(text, "$[0]")).otherwise(bare)

    a, b = (nodes.select(F.col("node_id").alias(end), F.col("lat").alias(f"lat{i}"), F.col("lng").alias(f"lng{i}")) for i, end in ((1, "u"), (2, "v")))
    placed = edges.join(a, "u").join(b, "v")
    return placed.select(F.coalesce(one("osmid"), F.concat_ws("_", "u", "v", "key")).alias("edge_id"), F.col("u").alias("from_node"), F.col("v").alias("to_node"), "lat1", "lng1", "lat2", "lng2", F.coalesce(F.col("oneway"), F.lit(False)).alias("oneway"), F.coalesce(one("name"), F.lit("")).alias("name"))


def _typed(column: str, name: str) -> Column:
    kind = "boolean" if name.startswith(("Is_", "Gnss_Rejected", "GNSS_Uncorroborated", "GNSS_Applied")) else "string" if name in ("Time_ISO", "Source_Type", "ZUPT_State") else "long" if name.endswith(("Epoch_Ms", "CB_Timestamp")) else "double"
    return F.expr(f"try_cast(nullif(trim(`{column}`), '') AS {kind})")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry CSV of any of its layouts, in one folder too, by header names: lines that begin with # are skipped, rows without a position dropped.

    Missing accuracy is 15, missing speed and heading 0; `row` numbers the rows that stay, from 0, in each file.
    """
    parts = []
    for files in by_header(spark, path, "#"):
        raw = spark.read.option("header", True).option("comment", "#").csv(files)
        names = {c: c.strip() for c in raw.columns}
        parts.append(raw.select(*(_typed(c, n).alias(n) for c, n in names.items()), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id")))
    rows = united(parts)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in TELEMETRY_DEFAULTS.items() if c in rows.columns})
    placed = rows.where("Latitude IS NOT NULL AND Longitude IS NOT NULL AND NOT isnan(Latitude) AND NOT isnan(Longitude)")
    return placed.withColumn("row", F.row_number().over(W.partitionBy("file").orderBy("_id")).cast("long") - 1).drop("_id")


def pair_sessions(files: DataFrame) -> DataFrame:
    """Phone and vehicle files of one folder (table: path): by exact name, else by lower-cased name, else as the folder's only two.

    session, category (first part of the path), s_path and v_path, for every phone file with a partner.
    """
    named = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([SV])-([^/]*)\.csv$", 1).alias("kind"), F.regexp_extract("path", r"([SV])-([^/]*)\.csv$", 2).alias("name")).where("kind <> ''")
    sized = named.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("dir", "kind")))
    s, v = sized.where("kind = 'S'").alias("s"), sized.where("kind = 'V'").alias("v")
    exact, lower, only = F.col("s.name") == F.col("v.name"), F.lower("s.name") == F.lower("v.name"), (F.col("s._n") == 1) & (F.col("v._n") == 1)
    tried = s.join(v, (F.col("s.dir") == F.col("v.dir")) & (exact | lower | only)).withColumn("_rank", F.when(exact, 0).when(lower, 1).otherwise(2))
    best = tried.groupBy(F.col("s.path").alias("s_path"), F.col("s.name").alias("session")).agg(F.min_by("v.path", F.struct("_rank", "v.path")).alias("v_path"))
    return best.select("session", F.regexp_extract(F.ltrim(F.col("s_path"), F.lit("/")), r"^([^/]*)/", 1).alias("category"), "s_path", "v_path")


OVERPASS = "elements array<struct<type string, id bigint, lat double, lon double, nodes array<bigint>, geometry array<struct<lat double, lon double>>, tags map<string,string>>>"


def overpass_ways(answers: DataFrame, body: str = "body", excluded: tuple[str, ...] = ("proposed", "construction", "abandoned", "platform", "raceway")) -> DataFrame:
    """Ways of saved answers in geometry form: way_id, road_type, oneway, nodes (node_id, lat, lng)."""
    ways = answers.select(F.explode(F.from_json(body, OVERPASS)["elements"]).alias("e")).where("e.type = 'way' AND size(e.nodes) >= 2 AND size(e.nodes) = size(e.geometry)")
    kind = F.coalesce(F.col("e.tags")["highway"], F.lit("unclassified"))
    return ways.where(~kind.isin(*excluded)).select(F.col("e.id").alias("way_id"), kind.alias("road_type"), F.coalesce(F.col("e.tags")["oneway"], F.lit("no")).alias("oneway"), F.zip_with("e.nodes", "e.geometry", lambda n, g: F.struct(n.alias("node_id"), g["lat"].alias("lat"), g["lon"].alias("lng"))).alias("nodes"))


def overpass_nodes(answers: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of saved answers in node form; of a repeated node one stays."""
    every = answers.select(F.explode(F.from_json(body, OVERPASS)["elements"]).alias("e"))
    ways = every.where("e.type = 'way'").select(F.col("e.id").alias("way_id"), F.coalesce(F.col("e.tags")["highway"], F.lit("unclassified")).alias("road_type"), F.col("e.nodes").alias("refs"))
    nodes = every.where("e.type = 'node'").select(F.col("e.id").alias("node_id"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lng")).dropDuplicates(["node_id"])
    return ways, nodes
