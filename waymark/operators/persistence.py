"""Write and read semantics of stored sessions, points, routes and road cells, as joins and ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, only the columns `updated` come from the new row. Keys are unique on each side."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def pick(c: str) -> Column:
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        prefers_new = F.col("a._old").isNull() | (F.col("b._new").isNotNull() & F.lit(c in updated))
        return F.when(prefers_new, n).otherwise(o).alias(c)

    return joined.select(*(pick(c) for c in old.columns))


def without_orphans(points: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """The points; a session that is not stored becomes null."""
    known = sessions.select(F.col(key).alias("_known")).distinct()
    joined = points.join(known, F.col(key) == F.col("_known"), "left")
    return joined.withColumn(key, F.col("_known")).drop("_known")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in `order`: what makes a replayed insert idempotent."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def with_points(sessions: DataFrame, points: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each session with the array of its points in order; empty without points."""
    lists = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("points"))
    return sessions.join(lists, key, "left").withColumn("points", F.coalesce("points", F.array().cast(lists.schema["points"].dataType)))


def recent(sessions: DataFrame, created: str, key: str, n: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc(created), key).limit(n)


def latest_routes(routes: DataFrame, profiles: list[str], default: str, keys: list[str], order: str, payload: str) -> DataFrame:
    """Last write wins for each (profile, coordinates); an unknown profile counts as `default`."""
    known = routes.withColumn("profile", F.when(F.col("profile").isin(*profiles), F.col("profile")).otherwise(default))
    return known.groupBy("profile", *keys).agg(F.max_by(payload, order).alias(payload), F.max(order).alias(order))


def cached_cells(cells: DataFrame, age_ms: Column, online: Column, ttl_ms: int = 14 * 24 * 3600 * 1000) -> DataFrame:
    """Whether a cell is served and stale: fresh ones are, expired ones only offline."""
    fresh = age_ms <= ttl_ms
    return cells.withColumn("stale", ~fresh).withColumn("served", fresh | ~online)


def split_valid(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required values, quarantined rows); an empty text is no value."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
        if rows.schema[c].dataType.typeName() == "string":
            whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return rows.where(whole), rows.where(~whole)


def poi_search(places: DataFrame, name: str, wanted: str) -> DataFrame:
    return places.where(F.contains(F.lower(name), F.lit(wanted.lower())))


def formatted(rows: DataFrame, columns: list[tuple[str, int | None]]) -> DataFrame:
    """Text columns: values with fixed decimals, booleans as TRUE and FALSE, null and NaN empty."""
    kinds = dict(rows.dtypes)

    def cell(c: str, places: int | None) -> Column:
        x = F.col(c)
        if kinds[c] == "boolean":
            x = F.when(x, "TRUE").otherwise(F.when(~x, "FALSE"))
        elif kinds[c] in ("double", "float"):
            x = F.when(~F.isnan(x), F.round(x, places or 0).cast(f"decimal(30,{places or 0})").cast("string"))
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)

    return rows.select(*(cell(c, p) for c, p in columns))


def csv_lines(rows: DataFrame, columns: list[tuple[str, int | None]]) -> DataFrame:
    """The same as one text column `line`."""
    return formatted(rows, columns).select(F.concat_ws(",", *(c for c, _ in columns)).alias("line"))


def write_csv(rows: DataFrame, columns: list[tuple[str, int | None]], path: str) -> None:
    """A folder of CSV files with a header each, written in parallel."""
    formatted(rows, columns).write.option("header", True).option("emptyValue", "").csv(path)


def span_geojson(rows: DataFrame, keys: list[str], order: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """For each span a LineString of its points, [lng, lat] each, as JSON."""
    points = F.transform(F.array_sort(F.collect_list(F.struct(order, lng, lat))), lambda p: F.array(p[lng], p[lat]))
    lines = rows.groupBy(*keys).agg(points.alias("_points"))
    return lines.select(*keys, F.size("_points").cast("long").alias("n_points"), F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("_points").alias("coordinates"))).alias("geometry"))


#: The columns of the telemetry export in order, each with its source column and decimals.
#: None stands for text, -1 for a truth value.
EXPORT = (("Timestamp_Epoch_Ms", "t_ms", None), ("Time_ISO", "_iso", None), ("Source_Type", "_source", None), ("Latitude", "lat", 6), ("Longitude", "lng", 6), ("Accuracy_Meters", "accuracy_m", 1), ("Speed_KmH", "speed_kmh", 1), ("Heading_Deg", "heading_deg", 1), ("Altitude_Meters", "altitude_m", 1), ("Is_Dead_Reckoning", "_dr", -1), ("IMU_VarA", "var_a", 6), ("IMU_VarG", "var_g", 6), ("GNSS_Speed_Raw_KmH", "raw_speed_kmh", 2), ("GNSS_Accuracy_Raw", "raw_accuracy_m", 1), ("ZUPT_State", "_zupt", None), ("Gnss_Rejected", "gnss_rejected", -1), ("GNSS_Uncorroborated", "gnss_uncorroborated", -1), ("Raw_CB_Latitude", "cb_lat", 6), ("Raw_CB_Longitude", "cb_lng", 6), ("Raw_CB_Accuracy", "cb_accuracy_m", 1), ("Raw_CB_Speed_mps", "cb_speed_mps", 2), ("Raw_CB_Heading", "cb_heading_deg", 1), ("Raw_CB_Timestamp", "cb_t_ms", None), ("GNSS_Applied_This_Tick", "gnss_applied", -1), ("Raw_DR_VelX_ms", "ins_vel_x", 4), ("Raw_DR_VelY_ms", "ins_vel_y", 4), ("AI_Corrected_VelX_ms", "ai_vel_x", 4), ("AI_Corrected_VelY_ms", "ai_vel_y", 4), ("AI_Confidence", "ai_confidence", 4), ("GPS_GroundTruth_Lat", "_true_lat", 6), ("GPS_GroundTruth_Lng", "_true_lng", 6), ("Matched_Latitude", "matched_lat", 6), ("Matched_Longitude", "matched_lng", 6))
#: The columns of the prototype's tick log in order, with their decimals.
TICK_LOG = (("timestamp", None), ("accel_x", 4), ("accel_y", 4), ("accel_z", 4), ("gyro_x", 4), ("gyro_y", 4), ("gyro_z", 4), ("gnss_lat", 8), ("gnss_lng", 8), ("gnss_accuracy", 2), ("lat", 8), ("lng", 8), ("vel_x", 4), ("vel_y", 4), ("vel_z", 4), ("heading", 2), ("source_mode", None), ("gnss_state", None), ("pure_ins_lat", 8), ("pure_ins_lng", 8))


def telemetry_export(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 33 text columns of the telemetry export, after the columns `keep` as text; source columns that `rows` lacks are empty.

    A rejected fix counts as dead reckoning, a missing rest state follows from the speed, and the
    truth is the raw callback's position where no other is given. Missing truth values read FALSE.
    """
    has = set(rows.columns)
    rejected = F.coalesce(F.col("gnss_rejected"), F.lit(False)) if "gnss_rejected" in has else F.lit(False)
    out = F.coalesce(F.col("is_dr"), F.lit(False)) | rejected

    def first(*names: str) -> Column:
        return F.coalesce(*(F.col(n) for n in names if n in has), F.lit(None).cast("double"))

    moving = F.when(F.coalesce(F.col("speed_kmh") > 0.5, F.lit(False)), "RELEASED").otherwise("LOCKED")
    given = F.when(F.col("zupt_state") != "", F.col("zupt_state")) if "zupt_state" in has else F.lit(None).cast("string")
    derived = rows.withColumns({"_iso": F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "_source": F.when(out, "DEAD_RECKONING").otherwise("GNSS"), "_dr": out, "_zupt": F.coalesce(given, moving), "_true_lat": first("true_lat", "cb_lat"), "_true_lng": first("true_lng", "cb_lng")})

    def column(source: str, places: int | None) -> Column:
        known = source in derived.columns
        if places == -1:
            return F.coalesce(F.col(source), F.lit(False)) if known else F.lit(False)
        return F.col(source) if known else F.lit(None).cast("string" if places is None else "double")

    return formatted(derived.select(*keep, *(column(c, p).alias(n) for n, c, p in EXPORT)), [*((k, None) for k in keep), *((n, None if p == -1 else p) for n, _, p in EXPORT)])


def write_telemetry_export(rows: DataFrame, path: str, *, origin: str | None = None, destination: str | None = None, distance_km: float | None = None, start_iso: str | None = None) -> None:
    """The export as one file of one session: lines of metadata, header, rows in order of `seq`, CRLF after each line.

    The rows, bounded by what one trip has, are sorted into one partition; write many sessions as Parquet instead.
    """
    facts = ((origin, "Origin: %s"), (destination, "Destination: %s"), (distance_km, "Distance: %s km"), (start_iso, "Session Start: %s"))
    head = [f"# {text % value}" for value, text in facts if value] + [",".join(n for n, _, _ in EXPORT)]
    keyed = telemetry_export(rows, keep=("seq",)).select(F.concat_ws(",", *(n for n, _, _ in EXPORT)).alias("value"), F.lit(1).alias("_part"), F.col("seq").cast("long").alias("_at"))
    top = rows.sparkSession.createDataFrame([(line, 0, i) for i, line in enumerate(head)], "value string, _part int, _at long")
    top.unionByName(keyed).coalesce(1).sortWithinPartitions("_part", "_at").select("value").write.option("lineSep", "\r\n").text(path)


def tick_log(rows: DataFrame) -> DataFrame:
    """The 20 columns of the prototype's log as one text column `line`; a null number is empty."""
    return csv_lines(rows, list(TICK_LOG))


def write_labelled(rows: DataFrame, path: str, key: str = "session_id") -> None:
    """One folder of CSV with a header for each session, written in parallel, each session's rows in order of `seq`."""
    rows.repartition(key).sortWithinPartitions(key, "seq").write.option("header", True).partitionBy(key).csv(path)
