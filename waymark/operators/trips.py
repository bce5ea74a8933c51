"""Sequence operators over telemetry: islands, running sums, alignment, frames and trip metrics.

All are window expressions partitioned by session and ordered by `seq`, so one shuffle by session
serves any chain of them and memory is bounded by a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geodesy import haversine

KEY, ORDER = "session_id", "seq"


def along(*order: str) -> WindowSpec:
    return W.partitionBy(KEY).orderBy(*(order or (ORDER,)))


def step_distance(lat: str = "lat", lng: str = "lng") -> Column:
    """Metres since the row before; 0 for the first."""
    w = along()
    return F.coalesce(haversine(F.lag(lat).over(w), F.lag(lng).over(w), F.col(lat), F.col(lng)), F.lit(0.0))


def with_island(rows: DataFrame, condition: Column, name: str = "island") -> DataFrame:
    """Number the maximal runs of rows on which `condition` does not change, from 1 in each session."""
    w = along()
    flagged = rows.withColumn("_on", F.coalesce(condition, F.lit(False)))
    started = flagged.withColumn("_new", F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(1)))
    return started.withColumn(name, F.sum("_new").over(w)).drop("_on", "_new")


def consecutive(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """How many rows in a row, this one included, meet `condition`; 0 where it fails."""
    numbered = with_island(rows.withColumn("_met", F.coalesce(condition, F.lit(False))), F.col("_met"), "_run")
    count = F.row_number().over(W.partitionBy(KEY, "_run").orderBy(ORDER))
    return numbered.withColumn(name, F.when(F.col("_met"), count).otherwise(0)).drop("_met", "_run")


def outage_spans(rows: DataFrame) -> DataFrame:
    """One row for each dead-reckoning span: its rows, path, mean speed, and the gap to the next fix.

    Anchors are the fixes next to the span; a span at the end of a session has no next anchor.
    """
    w = along()
    placed = rows.select(KEY, ORDER, "t_ms", "lat", "lng", "speed_kmh", "is_dr", F.lag("is_dr").over(w).alias("_was"), step_distance().alias("step"), F.lead("lat").over(w).alias("next_lat"), F.lead("lng").over(w).alias("next_lng"))
    spans = with_island(placed, F.col("is_dr")).where("is_dr")
    inside = F.when(F.coalesce(F.col("_was"), F.lit(False)), F.col("step")).otherwise(0.0)
    last = F.struct("lat", "lng", "next_lat", "next_lng")
    found = spans.groupBy(KEY, "island").agg(F.min(ORDER).alias("first_seq"), F.max(ORDER).alias("last_seq"), F.count(F.lit(1)).alias("n_rows"), F.sum(inside).alias("progress_m"), F.max(inside).alias("max_step_m"), F.percentile(inside, 0.95).alias("p95_step_m"), F.avg("speed_kmh").alias("avg_speed_kmh"), (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"), F.max_by(last, ORDER).alias("end"))
    gap = haversine(F.col("end.lat"), F.col("end.lng"), F.col("end.next_lat"), F.col("end.next_lng"))
    return found.withColumn("endpoint_error_m", gap).drop("end", "island")


def longest_frozen(rows: DataFrame, speed_kmh: float = 5.0, step_m: float = 0.5) -> DataFrame:
    """Per session the longest run of rows that claim to move but stay."""
    counted = consecutive(rows.withColumn("step", step_distance()), (F.col("speed_kmh") > speed_kmh) & (F.col("step") < step_m), "frozen")
    return counted.groupBy(KEY).agg(F.max("frozen").cast("long").alias("longest_frozen"))


def trip_summary(rows: DataFrame) -> DataFrame:
    """Path, duration, shares of fixes and dead reckoning, speeds."""
    walked = rows.withColumn("step", step_distance())
    n = F.count(F.lit(1))
    dr = F.count_if("is_dr")
    return walked.groupBy(KEY).agg(n.alias("n_points"), (F.sum("step") / 1000).alias("path_km"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("duration_s"), (n - dr).alias("n_gnss"), dr.alias("n_dr"), F.floor(100 * (n - dr) / n + 0.5).alias("gnss_pct"), F.floor(100 * dr / n + 0.5).alias("dr_pct"), F.avg("speed_kmh").alias("avg_kmh"), F.max("speed_kmh").alias("max_kmh"))


def unwrapped(rows: DataFrame, raw: str, name: str = "t_unwrapped", gap: int = 100) -> DataFrame:
    """A clock that restarts becomes a running one: where it falls back, the fall plus `gap` is added from there on."""
    w = along()
    fall = F.lag(raw).over(w) - F.col(raw)
    marked = rows.withColumn("_fall", F.when(fall > 0, fall + gap).otherwise(0))
    return marked.withColumn(name, F.col(raw) + F.sum("_fall").over(w)).drop("_fall")


def seconds_from_start(rows: DataFrame, raw: str, name: str = "t_rel") -> DataFrame:
    """Seconds since the session's first row; values beyond 1e5 are read as milliseconds."""
    session = W.partitionBy(KEY)
    scaled = F.when(F.max(raw).over(session) > 1e5, F.col(raw) / 1000.0).otherwise(F.col(raw).cast("double"))
    return rows.withColumn("_s", scaled).withColumn(name, F.col("_s") - F.first("_s").over(along())).drop("_s")


def interpolated(samples: DataFrame, truth: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """Linear interpolation of truth columns at the samples' times, held constant outside the truth's range.

    Both sides are put in one order by session and time; the nearest truth rows before and after come
    from two running windows. Of truth rows with one time the first by value is used, as a whole row.
    """
    known = truth.groupBy(KEY, at).agg(F.min(F.struct(*columns)).alias("_one")).select(KEY, at, *(F.col("_one")[c].alias(c) for c in columns))
    both = samples.select("*", *(F.lit(None).cast("double").alias(f"_{c}") for c in columns), F.lit(None).cast(samples.schema[at].dataType).alias("_t")).unionByName(known.select(KEY, at, *(F.col(c).alias(f"_{c}") for c in columns), F.col(at).alias("_t")), allowMissingColumns=True)
    back, ahead = (W.partitionBy(KEY).orderBy(order).rangeBetween(W.unboundedPreceding, 0) for order in (F.asc(at), F.desc(at)))
    names = ["_t", *(f"_{c}" for c in columns)]
    near = both.select("*", *(F.last(n, ignorenulls=True).over(back).alias(f"{n}_a") for n in names), *(F.last(n, ignorenulls=True).over(ahead).alias(f"{n}_b") for n in names)).where(F.col(ORDER).isNotNull())
    share = F.coalesce(F.try_divide(F.col(at) - F.col("_t_a"), (F.col("_t_b") - F.col("_t_a")).cast("double")), F.lit(0.0))

    def value(c: str) -> Column:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + share * (b - a))

    return near.select(*samples.columns, *(value(c).alias(f"true_{c}") for c in columns))


def trapezoid(rows: DataFrame, value: str, time: str, name: str) -> DataFrame:
    """Running integral by the trapezoid rule; the time step is at least a microsecond."""
    w = along()
    dt = F.greatest(F.col(time) - F.lag(time).over(w), F.lit(1e-6))
    area = F.coalesce(0.5 * (F.col(value) + F.lag(value).over(w)) * dt, F.lit(0.0))
    return rows.withColumn("_area", area).withColumn(name, F.sum("_area").over(w)).drop("_area")


def resettable_trapezoid(rows: DataFrame, value: str, time: str, reset: Column, base: str, name: str) -> DataFrame:
    """The same, begun anew from column `base` at each row where `reset` holds."""
    w = along()
    dt = F.greatest(F.col(time) - F.lag(time).over(w), F.lit(1e-6))
    area = F.coalesce(0.5 * (F.col(value) + F.lag(value).over(w)) * dt, F.lit(0.0))
    cut = rows.withColumn("_reset", F.coalesce(reset, F.lit(False))).withColumn("_leg", F.sum(F.col("_reset").cast("int")).over(w)).withColumn("_area", F.when(F.col("_reset"), 0.0).otherwise(area))
    leg = W.partitionBy(KEY, "_leg").orderBy(ORDER)
    start = F.when(F.col("_leg") > 0, F.first(base).over(leg)).otherwise(0.0)
    return cut.withColumn(name, start + F.sum("_area").over(leg)).drop("_reset", "_leg", "_area")


def without_initial_bias(rows: DataFrame, column: str, name: str, samples: int = 100) -> DataFrame:
    """Less the mean of the session's first `samples` rows."""
    first = F.avg(F.when(F.col(ORDER) <= samples, F.col(column))).over(W.partitionBy(KEY))
    return rows.withColumn(name, F.col(column) - first)


def majority(rows: DataFrame, label: str, name: str, size: int = 5) -> DataFrame:
    """The most frequent of the last `size` labels; of equals the one seen first in them."""
    recent = F.collect_list(label).over(along().rowsBetween(1 - size, 0))
    counted = F.transform(F.array_distinct("_recent"), lambda x: F.struct(F.size(F.filter("_recent", lambda y: y == x)).alias("n"), (-F.array_position("_recent", x)).alias("place"), x.alias("label")))
    return rows.withColumn("_recent", recent).withColumn(name, F.array_max(counted)["label"]).drop("_recent")


def compressed_stationary(rows: DataFrame, speed_kmh: float = 1.0) -> DataFrame:
    """Runs of slow dead-reckoning rows shrink to their last; other rows stay. `kept_for` counts the rows a row stands for."""
    slow = F.col("is_dr") & (F.col("speed_kmh") < speed_kmh)
    runs = with_island(rows.withColumn("_slow", slow), F.col("_slow"), "_run")
    group = F.when(F.col("_slow"), F.col("_run")).otherwise(-F.col(ORDER))
    return runs.groupBy(KEY, group.alias("_group")).agg(F.max(ORDER).alias(ORDER), F.max_by("lat", ORDER).alias("lat"), F.max_by("lng", ORDER).alias("lng"), F.count(F.lit(1)).alias("kept_for")).drop("_group")


def steps_since_anchor(rows: DataFrame) -> DataFrame:
    """0 on fixes; on dead-reckoning rows their number since the last fix."""
    return consecutive(rows, F.col("is_dr"), "dr_step")


def not_late(rows: DataFrame, time: str = "t_ms") -> DataFrame:
    """Drop rows whose time is before the latest accepted one, in arrival order; equal times pass."""
    latest = F.max(time).over(along().rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_latest", latest).where(F.col("_latest").isNull() | (F.col(time) >= F.col("_latest"))).drop("_latest")


def clocked(rows: DataFrame, time: str = "t_ms", most_s: float = 1.0) -> DataFrame:
    """dt and whether a sample is used: not if its step is not positive or beyond `most_s`. The clock moves in any case."""
    dt = (F.col(time) - F.lag(time).over(along())) / 1000.0
    return rows.withColumn("dt", dt).withColumn("used", F.coalesce((F.col("dt") > 0) & (F.col("dt") <= most_s), F.lit(False)))


def last_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last `n` rows of each session."""
    w = W.partitionBy(KEY).orderBy(*(F.desc(c) for c in order or (ORDER,)))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def session_diagnostics(rows: DataFrame) -> DataFrame:
    """Counts, duration, sampling rate, gaps beyond twice the median step, repeated times, ranges."""
    w = along()
    stepped = rows.withColumn("dt", (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000.0)
    basic = stepped.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"), ((F.max("t_ms") - F.min("t_ms")) / 1000.0).alias("duration_s"), F.median("dt").alias("median_dt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), (F.count("t_ms") - F.countDistinct("t_ms")).alias("n_duplicates"), F.count_if(F.col("speed_kmh").isNull() | F.isnan("speed_kmh")).alias("n_missing"), F.min("speed_kmh").alias("min_speed"), F.max("speed_kmh").alias("max_speed"), F.avg("speed_kmh").alias("mean_speed"), F.stddev_pop("speed_kmh").alias("std_speed"))
    gaps = stepped.join(basic.select(KEY, "median_dt"), KEY).groupBy(KEY).agg(F.count_if(F.col("dt") > 2 * F.col("median_dt")).alias("n_gaps"))
    return basic.join(gaps, KEY).withColumn("hz", F.when(F.col("median_dt") > 0, F.try_divide(F.lit(1.0), F.col("median_dt"))))


def drift(rows: DataFrame, error: Column) -> DataFrame:
    """Errors of a session against truth: RMSE, MAE, final error, and final error in percent of the path.

    The percentage is infinite for a path below one metre.
    """
    walked = rows.withColumn("_e", error).withColumn("_step", step_distance())
    found = walked.groupBy(KEY).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.max_by("_e", ORDER).alias("final_error"), F.sum("_step").alias("path_m"))
    return found.withColumn("drift_pct", F.when(F.col("path_m") >= 1, 100 * F.try_divide(F.abs("final_error"), F.col("path_m"))).otherwise(float("inf")))


def in_blackout(rows: DataFrame, start: float = 0.4, seconds: float = 60.0, time: str = "t_sec") -> DataFrame:
    """Flag rows from `start` of the session's span for `seconds`, both ends included."""
    session = W.partitionBy(KEY)
    low, high = F.min(time).over(session), F.max(time).over(session)
    begin = low + start * (high - low)
    return rows.withColumn("blackout", F.col(time).between(begin, begin + seconds))


def in_blackout_rows(rows: DataFrame, start: float = 0.4, count: int = 20) -> DataFrame:
    """Flag `count` rows from row floor(start * n) on."""
    n = F.count(F.lit(1)).over(W.partitionBy(KEY))
    first = F.floor(n * start)
    return rows.withColumn("blackout_row", (F.col(ORDER) - 1 >= first) & (F.col(ORDER) - 1 < first + count))


def outage_latency(rows: DataFrame) -> DataFrame:
    """For each return of the fixes: when they were lost, when they came back, and the milliseconds between."""
    w = along()
    marked = rows.withColumn("_was", F.lag("is_dr").over(w)).where("is_dr <> coalesce(_was, false)")
    pairs = marked.withColumn("returned_ms", F.lead("t_ms").over(w)).where("is_dr")
    return pairs.select(KEY, F.col("t_ms").alias("lost_ms"), "returned_ms", (F.col("returned_ms") - F.col("t_ms")).alias("latency_ms"))


def replay_metrics(rows: DataFrame, moving_kmh: float = 5.0) -> DataFrame:
    """Fixes, rejected ones while moving and while standing, and the largest change of speed between rows."""
    stepped = rows.withColumn("_dv", F.abs(F.col("speed_kmh") - F.lag("speed_kmh").over(along())))
    return stepped.groupBy(KEY).agg(F.count_if(~F.col("is_dr")).alias("n_fixes"), F.count_if(F.col("is_dr") & (F.col("speed_kmh") > moving_kmh)).alias("rejected_moving"), F.count_if(F.col("is_dr") & (F.col("speed_kmh") <= moving_kmh)).alias("rejected_standing"), F.max("_dv").alias("max_delta_kmh"))


def staleness(rows: DataFrame, *, time: str = "t_ms", stale_s: float = 10.0, speed_s: float = 2.5, source_s: float = 6.0) -> DataFrame:
    """Age in seconds of the last fix at each row, and whether it is stale, its speed fresh and its source fresh.

    The age is null before the first fix, which is then neither stale nor fresh.
    """
    fixed = F.last(F.when(~F.col("is_dr"), F.col(time)), ignorenulls=True).over(along())
    aged = rows.withColumn("age_s", (F.col(time) - fixed) / 1000.0)
    known = {"stale": F.round("age_s") > stale_s, "speed_fresh": F.col("age_s") < speed_s, "source_fresh": F.col("age_s") < source_s}
    return aged.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in known.items()})


def imu_anomalies(rows: DataFrame, axes: list[str], *, time: str = "t_ms", repeats: int = 15, gap_ms: int = 10_000) -> DataFrame:
    """Samples of a frozen sensor (`repeats` identical ones after the first) and of a clock that falls back or leaps, with the severity.

    A clock is judged only against a time above 0.
    """
    w = along()
    same = F.lit(True)
    for axis in axes:
        same = same & (F.col(axis) == F.lag(axis).over(w))
    counted = consecutive(rows, same, "_same")
    last = F.lag(time).over(w)
    dt = F.col(time) - last
    flagged = counted.withColumns({"frozen": F.col("_same") >= repeats, "clock": F.coalesce((last > 0) & ((dt < 0) | (dt > gap_ms)), F.lit(False))})
    return flagged.withColumn("severity", F.when(F.col("frozen"), "HIGH").when(F.col("clock"), "MEDIUM").otherwise("NONE")).drop("_same")


def held_correction(rows: DataFrame, value: str, confidence: str, state: str, name: str, least: float = 0.05) -> DataFrame:
    """The last correction a row has seen, null with good fixes or where that correction's confidence is too low; it never expires."""
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(confidence).alias("c"))), ignorenulls=True).over(along())
    return rows.withColumn("_last", last).withColumn(name, F.when((F.col(state) != "GOOD") & (F.col("_last.c") >= least), F.col("_last.v"))).drop("_last")


def compared_methods(drifts: DataFrame, base: str, sane: float = 1e6) -> DataFrame:
    """Mean and median drift of each method (rows: method, drift_pct), and by how much its mean is below that of `base`, in percent.

    Drifts that are null, no number or not below `sane` do not count.
    """
    by = drifts.where((F.col("drift_pct") < sane) & ~F.isnan("drift_pct")).groupBy("method").agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("drift_pct").alias("mean_drift"), F.median("drift_pct").alias("median_drift"))
    mean = F.max(F.when(F.col("method") == base, F.col("mean_drift"))).over(W.partitionBy(F.lit(1)))  # a row a method
    return by.withColumn("gain_pct", 100 * (1 - F.try_divide(F.col("mean_drift"), mean)))


def magnitude_statistics(rows: DataFrame, triples: dict[str, list[str]]) -> DataFrame:
    """Least, greatest, mean and population deviation of the length of each named triple of columns, by session."""
    lengths = {n: F.sqrt(sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0))) for n, axes in triples.items()}
    return rows.groupBy(KEY).agg(*(f(x).alias(f"{p}_{n}") for n, x in lengths.items() for p, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))
