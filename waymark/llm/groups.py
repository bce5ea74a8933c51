"""Places and running sums of rows within groups of any size, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import written

#: Columns that these functions add; rows must not have them.
PLACE, SIZE, BEFORE, PART, AT = "_place", "_size", "_before", "_part", "_at"


def placed(rows: DataFrame, group: str, order_by: list[str], summed: str | None = None) -> DataFrame:
    """`rows` with `_place` (from 0, by `order_by`, within their `group`), `_size` (rows of the group) and, if `summed` is named, `_before`: the sum of it over the rows before.

    Rows are dealt by ranges of (group, order, arrival), so a hot group is spread over tasks; counts
    of each group in each task, a table as large as tasks and groups together, give where its rows
    begin. Nulls are a group of their own and sort first; rows equal in all of `order_by` are placed
    among themselves in any order.
    """
    by = [group, *order_by, AT]
    sorted_rows = rows.withColumn(AT, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(AT)
    kept = written(sorted_rows.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    total = F.sum(F.coalesce(F.col(summed), F.lit(0))) if summed else F.lit(0).cast("long")
    sizes = kept.groupBy(F.col(group).alias("_g"), F.col(PART).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min(AT).alias("_first"), total.alias("_sum"))
    whole = W.partitionBy("_g")
    until = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select("_g", "_p", (F.sum("_n").over(until) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(SIZE), (F.sum("_sum").over(until) - F.col("_sum")).alias("_earlier"))
    if summed:
        here = W.partitionBy(group, PART).orderBy(AT).rowsBetween(W.unboundedPreceding, W.currentRow)
        value = F.coalesce(F.col(summed), F.lit(0))
        kept = kept.withColumn(BEFORE, F.sum(value).over(here) - value)
    joined = kept.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col(PART) == F.col("_p")))
    found = joined.withColumn(PLACE, F.col(AT) + F.col("_shift"))
    if summed:
        found = found.withColumn(BEFORE, F.col(BEFORE) + F.col("_earlier"))
    return found.drop("_g", "_p", "_shift", "_earlier", PART, AT)


def numbered(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """`rows` with `_place`, from 0 over all rows by `order_by`; null keys first."""
    return placed(rows.withColumn("_all", F.lit(0)), "_all", order_by).drop("_all", SIZE)
