"""The folds of `operators.estimators` over streams, and the stream helpers around them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.operators.trips import KEY, ORDER


class _Processor(StatefulProcessor):
    """Keeps one estimator a session; rows of a batch are put in order before they are taken."""

    def __init__(self, make: Callable[[], object], inputs: list[str], names: list[str], keep: tuple[str, ...], ttl_ms: int | None):
        self.make, self.inputs, self.names, self.keep, self.ttl_ms = make, inputs, names, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("estimator", "body binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True).sort_values(ORDER, kind="stable", ignore_index=True)
        estimator = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        found = [estimator.step(*row) for row in every[self.inputs].itertuples(index=False, name=None)]
        self.state.update((pickle.dumps(estimator),))
        yield pd.concat([every[[KEY, *self.keep]], pd.DataFrame(found, columns=self.names)], axis=1)

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, make: Callable[[], object], inputs: list[str], outputs: str, keep: tuple[str, ...] = (ORDER,), ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of `fold`: the same estimator, its state in the state store.

    Needs the RocksDB state store provider. Rows that arrive after later ones of their session were
    taken are processed as they come; use `dropped_late` first to drop them.
    """
    names = [part.split()[0] for part in outputs.split(", ")]
    narrow = rows.select(*dict.fromkeys((KEY, *keep, *inputs)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in (KEY, *keep))
    return narrow.groupBy(KEY).transformWithStateInPandas(_Processor(make, inputs, names, keep, ttl_ms), f"{kinds}, {outputs}", "append", "none")


class LateGate:
    """False for a row older than the latest accepted one; equal times pass."""

    OUTPUTS = "on_time boolean"

    def __init__(self) -> None:
        self.latest: float | None = None

    def step(self, t_ms: float) -> tuple:
        on_time = self.latest is None or t_ms >= self.latest
        if on_time:
            self.latest = t_ms
        return (on_time,)


class OutageTimer:
    """In row order: whether no fix came for 6 s of event time, said again after each further second."""

    OUTPUTS = "outage boolean"

    def __init__(self, after_ms: float = 6000.0, every_ms: float = 1000.0) -> None:
        self.after, self.every, self.fix, self.said = after_ms, every_ms, None, None

    def step(self, t_ms: float, is_fix: bool) -> tuple:
        if is_fix or self.fix is None:
            self.fix, self.said = t_ms, None
            return (False,)
        due = t_ms - self.fix > self.after and (self.said is None or t_ms - self.said >= self.every)
        if due:
            self.said = t_ms
        return (due,)


def with_watermark(rows: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as TIMESTAMP (a watermark rejects TIMESTAMP_NTZ) with a watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def append_once(rows: DataFrame, path: str, keys: list[str], checkpoint: str, *, time: str | None = None, delay: str | None = None):
    """Start a stream that appends rows whose keys are not stored yet; a replayed batch changes nothing.

    With `time` (a timestamp that a key determines), the target is cut by `day`, and a batch reads
    the keys of its own days only; without it, a batch reads all keys stored. With `delay` as well,
    repeats within it are dropped in the state store before, and so are rows later than that.
    """
    if time is not None and delay is not None:
        rows = with_watermark(rows, time, delay).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if time is not None:
            new = new.withColumn("day", F.to_date(time))
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            stored = spark.read.parquet(path)
            if time is not None:
                stored = stored.where(F.col("day").isin([r["day"] for r in new.select("day").distinct().collect()]))
            new = new.join(stored.select(*keys), keys, "left_anti")
        writer = new.write.mode("append")
        (writer if time is None else writer.partitionBy("day")).parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class _Latest(StatefulProcessor):
    """Keeps the last row of each session, by order; passes on the rows that become it."""

    def __init__(self, columns: list[str], schema: str):
        self.columns, self.schema = columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True)
        last = every.loc[[every[ORDER].idxmax()]]
        if not self.state.exists() or self.state.get()[self.columns.index(ORDER)] <= last[ORDER].iloc[0]:
            self.state.update(tuple(v.item() if hasattr(v, "item") else v for v in last[self.columns].iloc[0]))
            yield last[[KEY, *self.columns]]

    def close(self) -> None:
        pass


def keep_latest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A stream whose state is each session's last row (ORDER and `columns`), to be asked for by `latest_states` at any time."""
    names = list(dict.fromkeys((ORDER, *columns)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return rows.select(KEY, *names).groupBy(KEY).transformWithStateInPandas(_Latest(names, schema), f"{KEY} {kinds[KEY]}, {schema}", "update", "none")


def latest_states(spark: SparkSession, checkpoint: str, *, batch: int | None = None) -> DataFrame:
    """KEY and the last row of each session as the stream at `checkpoint` left it, after `batch` if given: a read of its state store, while it runs or after it stopped."""
    reader = spark.read.format("statestore").option("stateVarName", "latest")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return state.select(f"key.{KEY}", "value.*")
