"""Training and inference windows, their statistics, the split by session, and scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geodesy import finite_or_zero
from waymark.operators.trips import KEY, ORDER


def frames(rows: DataFrame, features: list[str], size: int) -> DataFrame:
    """Each row with the array of feature arrays of the last `size` rows, oldest first; broken values are 0."""
    values = F.array(*(finite_or_zero(F.col(c)).cast("float") for c in features))
    recent = F.collect_list("_x").over(W.partitionBy(KEY).orderBy(ORDER).rowsBetween(1 - size, 0))
    return rows.withColumn("_x", values).withColumn("window", recent).drop("_x")


def training_windows(rows: DataFrame, features: list[str], state: list[str], target: list[str], *, size: int = 20, stride: int = 5, clip: float = 50.0) -> DataFrame:
    """Windows that end at row size, size + stride, ... before a session's last row.

    State and target are those of the window's last row; a window whose target is beyond `clip` in
    any part is dropped.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(KEY))
    ended = frames(rows.withColumn("_n", n), features, size).where((F.col(ORDER) >= size) & (F.col(ORDER) < F.col("_n")) & ((F.col(ORDER) - size) % stride == 0))
    arrays = ended.select(KEY, F.col(ORDER).alias("end_row"), "window", F.array(*(finite_or_zero(F.col(c)).cast("float") for c in state)).alias("state"), F.array(*(finite_or_zero(F.col(c)).cast("float") for c in target)).alias("target"))
    return arrays.where(~F.exists("target", lambda x: F.abs(x) > clip))


def scored(rows: DataFrame, features: list[str], score: Callable[[np.ndarray], np.ndarray], *, size: int = 20) -> DataFrame:
    """Adds `score`, an array: that of `score(batch of windows)` from row `size` on and zeros before."""

    @F.pandas_udf("array<double>")
    def run(window: pd.Series) -> pd.Series:
        full = window.map(len) == size
        out = pd.Series([None] * len(window), dtype=object)
        if full.any():
            batch = np.array([np.stack(w) for w in window[full]], dtype=np.float32)
            out[full.to_numpy()] = pd.Series(list(np.asarray(score(batch), dtype=float)), index=out.index[full.to_numpy()])
        width = len(next((x for x in out if x is not None), [0.0, 0.0]))
        return out.map(lambda x: [0.0] * width if x is None else list(x))

    return frames(rows, features, size).withColumn("score", run("window")).drop("window")


def zero_model(batch: np.ndarray) -> np.ndarray:
    return np.zeros((len(batch), 2))


def linear_model(weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for a trained network: weights (features, outputs) on the window's mean."""
    return lambda batch: batch.mean(axis=1) @ weights


def channel_statistics(windows: DataFrame, array: str = "window") -> DataFrame:
    """Mean and population deviation plus 1e-8 of each channel over all rows of all windows."""
    values = windows.select(F.explode(array).alias("_row")).select(F.posexplode("_row").alias("channel", "_v"))
    return values.groupBy("channel").agg(F.avg("_v").alias("mean"), (F.stddev_pop("_v") + 1e-8).alias("deviation"))


def session_split(rows: DataFrame, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """session_id and split of every session: the sessions in the order of a seeded hash, cut by share.

    Above two sessions each held-out part has one at least. Sessions are numbered by a range shuffle
    and a sum over partitions, so no task holds them all.
    """
    place = F.xxhash64(F.lit(seed), KEY)
    ids = rows.select(KEY).distinct().withColumn("_place", place)
    n = ids.count()
    cuts = [max(1, int(n * share)) if n > 2 else 0 for share in (test, validation)]
    if n == 0:
        return ids.select(KEY, F.lit("train").alias("split"))
    bars = [_nth(ids, c) for c in (cuts[0], cuts[0] + cuts[1])]
    split: Column = F.when(F.col("_place") < bars[0], "test").when(F.col("_place") < bars[1], "validation").otherwise("train")
    return ids.select(KEY, split.alias("split"))


def _nth(ids: DataFrame, n: int) -> int:
    """The hash with `n` smaller ones, by halving its range: counts only, no sort."""
    low, high = -(1 << 63), (1 << 63) - 1
    shares = ids.groupBy(F.shiftright("_place", 48).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").toLocalIterator()
    before = 0
    for row in shares:
        if before + row["n"] > n:
            low, high = row["b"] << 48, ((row["b"] + 1) << 48) - 1
            inside = sorted(r["_place"] for r in ids.where(F.col("_place").between(low, high)).select("_place").toLocalIterator())
            return inside[n - before]
        before += row["n"]
    return high


def write_dataset(windows: DataFrame, path: str, *, size: int = 20, stride: int = 5, clip: float = 50.0) -> None:
    """The windows as Parquet under `windows`, the number of windows of each session under `sessions`, and the settings and total as JSON under `manifest`."""
    windows.write.parquet(f"{path}/windows")
    stored = windows.sparkSession.read.parquet(f"{path}/windows")
    stored.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_windows")).write.parquet(f"{path}/sessions")
    facts = stored.agg(F.count(F.lit(1)).alias("total_windows"))
    facts.select("total_windows", F.lit(clip).alias("clip_threshold"), F.lit(size).alias("window_size"), F.lit(stride).alias("stride")).write.json(f"{path}/manifest")
