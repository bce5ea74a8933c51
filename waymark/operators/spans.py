"""Outage spans with their anchors, and matched positions written back where they do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geodesy import haversine
from waymark.operators.matching import do_no_harm, match
from waymark.operators.roads import snapped
from waymark.operators.trips import KEY, ORDER, along

#: Keys of a row of a span: a fix between two spans is a row of both.
SPAN = [KEY, "span"]


def span_rows(rows: DataFrame, out: Column) -> DataFrame:
    """The rows on which `out` holds, numbered by maximal run from 1 in each session (`span`), and the anchors next to each run.

    `role` is before, span or after; a fix between two spans appears once for each. A null `out` is false.
    """
    w = along()
    flagged = rows.withColumn("_out", F.coalesce(out, F.lit(False)))
    near = flagged.withColumns({"_was": F.coalesce(F.lag("_out").over(w), F.lit(False)), "_will": F.coalesce(F.lead("_out").over(w), F.lit(False))})
    counted = near.withColumn("_n", F.sum((F.col("_out") & ~F.col("_was")).cast("long")).over(w))

    def part(holds: Column, number: Column, role: str) -> Column:
        return F.when(holds, F.struct(number.alias("span"), F.lit(role).alias("role")))

    n, fix = F.col("_n"), ~F.col("_out")
    parts = F.array_compact(F.array(part(F.col("_out"), n, "span"), part(fix & F.col("_was"), n, "after"), part(fix & F.col("_will"), n + 1, "before")))
    return counted.withColumn("_part", F.explode(parts)).select(*rows.columns, "_part.span", "_part.role")


def span_verdicts(matched: DataFrame, **limits: float) -> DataFrame:
    """Whether each span's match is kept, from its rows (`span_rows` with matched_lat and matched_lng).

    The last row is the anchor if it is no dead reckoning and not the only one; the row before it
    is compared with it, and the progress is that up to the row before it. A row without a match
    stands at its raw position.
    """
    w = W.partitionBy(*SPAN).orderBy(ORDER)
    lat, lng = F.coalesce("matched_lat", "lat"), F.coalesce("matched_lng", "lng")
    placed = matched.select(*SPAN, ORDER, "is_dr", "lat", "lng", lat.alias("_lat"), lng.alias("_lng"))
    was = {f"{c}0": F.lag(c).over(w) for c in ("lat", "lng", "_lat", "_lng")}
    stepped = placed.withColumns(was | {"_last": F.lead(ORDER).over(w).isNull()})
    lag, at, shift, there = (tuple(map(F.col, p)) for p in (("lat0", "lng0"), ("lat", "lng"), ("_lat0", "_lng0"), ("_lat", "_lng")))

    def over(holds: Column, a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
        return F.coalesce(F.sum(F.when(holds, haversine(*a, *b))), F.lit(0.0))

    last = F.col("_last")
    anchored = F.coalesce(F.bool_or(last & ~F.col("is_dr")), F.lit(False)) & (F.count(F.lit(1)) > 1)
    spans = stepped.groupBy(*SPAN).agg(over(last, lag, at).alias("raw_error_m"), over(last, shift, at).alias("matched_error_m"), over(~last, lag, at).alias("raw_progress_m"), over(~last, shift, there).alias("matched_progress_m"), anchored.alias("anchored"))
    return do_no_harm(spans, **limits)


def written_back(rows: DataFrame, matched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All rows, with matched_lat and matched_lng on the rows of spans whose match is kept, else null, and the span's verdict."""
    kept = matched.where("role = 'span'").join(verdicts.select(*SPAN, "verdict"), SPAN)
    taken = F.col("verdict") == "kept"
    mine = kept.select(KEY, ORDER, "span", "verdict", *(F.when(taken, F.col(c)).alias(c) for c in ("matched_lat", "matched_lng")))
    return rows.join(mine, [KEY, ORDER], "left")


def matched_spans(rows: DataFrame, edges: DataFrame, out: Column, **options: float) -> DataFrame:
    """Rows of the outage spans and their anchors with matched positions: each span is matched on its own, with its anchors."""
    parts = span_rows(rows, out)
    named = parts.withColumn("_name", F.concat_ws(":", KEY, "span"))
    asked = named.select(F.col("_name").alias(KEY), ORDER, "lat", "lng", "accuracy_m")
    found = match(asked, edges, **options).select(F.col(KEY).alias("_name"), ORDER, "matched_lat", "matched_lng", "edge_id")
    return named.join(found, ["_name", ORDER]).drop("_name")


def snapped_live(rows: DataFrame, segments: DataFrame, *, heading: str, speed: str, least: float = 0.4) -> DataFrame:
    """Final positions of a live session: a dead-reckoning row stands on its street where the snap's confidence is above `least`."""
    found = snapped(rows, segments, keys=[KEY, ORDER], heading=heading, speed=speed)
    on = F.col("is_dr") & (F.col("confidence") > least) & F.col("edge_id").isNotNull()
    return found.withColumns({"snapped": F.coalesce(on, F.lit(False)), "final_lat": F.when(on, F.col("proj_lat")).otherwise(F.col("lat")), "final_lng": F.when(on, F.col("proj_lng")).otherwise(F.col("lng"))})
