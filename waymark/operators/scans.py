"""Operators that depend on their own output, as scans and successor graphs, so that a session can be split.

A scan deals rows by ranges of session and order. A task first reduces its rows to what they do to a
state that comes in; the few numbers a task are composed in order, which gives each task the state it
begins with, and then the rows are run through. Only the first session of a task can have begun
before it, so the driver holds two rows a task, however many rows and sessions there are.

A greedy choice (the next row that is far enough from the last one chosen) is a path in the graph of
each row's successor: the path is found by doubling its jumps, in as many rounds as the logarithm of
its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.checkpoints import cut
from waymark.operators.trips import KEY, ORDER


class Scan(Protocol):
    """What `scanned` needs of an operator over rows whose inputs come as arrays."""

    outputs: str

    def transfer(self, *inputs: np.ndarray) -> Any:
        """What these rows do to any state."""

    def carried(self, state: Any, transfer: Any) -> Any:
        """The state after rows with this transfer."""

    def run(self, state: Any, *inputs: np.ndarray) -> tuple[list[np.ndarray], Any]:
        """Outputs of the rows from a state (None: a session's first rows) on, and the state after them."""


def _sessions(keys: pa.Array) -> list[tuple[Any, int, int]]:
    """(session, begin, end) of each session in a sorted column."""
    values = keys.to_pylist()
    cuts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
    return [(values[a], a, b) for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True)]


def scanned(rows: DataFrame, scan: Scan, inputs: list[str], keep: tuple[str, ...] = (ORDER,)) -> DataFrame:
    """KEY, columns `keep` and the scan's outputs of each row, in order of ORDER within a session; null keys are one session."""
    keep = tuple(dict.fromkeys(keep))
    narrow = rows.select(KEY, *(F.col(c) for c in keep if c != KEY), *(F.col(c).alias(f"_in_{c}") for c in inputs), F.col(ORDER).alias("_order"))
    dealt = cut(narrow.repartitionByRange(KEY, "_order").sortWithinPartitions(KEY, "_order").drop("_order").withColumn("_task", F.spark_partition_id()))
    names = [f"_in_{c}" for c in inputs]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, pa.RecordBatch]]:
        for batch in batches:
            for key, a, b in _sessions(batch.column(KEY)):
                yield key, batch.slice(a, b - a)

    def arrays(part: pa.RecordBatch) -> list[np.ndarray]:
        return [part.column(c).to_numpy(zero_copy_only=False) for c in names]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        task, first, now, onto, state = None, None, None, [], None
        for key, part in parts(batches):
            if task is None:
                task, first, now = part.column("_task")[0].as_py(), key, key
            if key != now:
                now, state = key, None
            if now == first and onto is not None:
                onto.append(scan.transfer(*arrays(part)))
            else:
                onto = None if now != first else onto
            state = scan.run(state, *arrays(part))[1]
        if task is not None:
            told = pickle.dumps((first, now, onto if now == first else None, state))
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "told": pa.array([told], pa.binary())})

    import pickle

    begins: dict[int, Any] = {}
    last, state = object(), None
    for row in dealt.mapInArrow(reduce, "task int, told binary").orderBy("task").collect():
        first, now, onto, fresh = pickle.loads(row["told"])
        goes_on = first == last
        if goes_on:
            begins[row["task"]] = state
        if goes_on and onto is not None:
            for transfer in onto:
                state = scan.carried(state, transfer)
        else:
            state = fresh
        last = now

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in (KEY, *keep)]
    out_names = [part.split()[0] for part in scan.outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for key, part in parts(batches):
            if not begun:
                now, state, begun = key, begins.get(part.column("_task")[0].as_py()), True
            elif key != now:
                now, state = key, None
            found, state = scan.run(state, *arrays(part))
            kept = [part.column(c) for c in (KEY, *(k for k in keep if k != KEY))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[KEY, *(k for k in keep if k != KEY), *out_names])

    return dealt.mapInArrow(run, ", ".join([*kinds, scan.outputs]))


class Ema:
    """y -> y + alpha (x - y), beginning at the first x: each row is an affine map, and rows compose to one."""

    outputs = "filtered double"

    def __init__(self, alpha: float):
        self.alpha = alpha

    def _maps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of the maps y -> a y + b of the first 1, 2, ... rows."""
        a, b = np.full(len(x), 1 - self.alpha), self.alpha * x
        step = 1
        while step < len(x):
            b[step:] += a[step:] * b[:-step].copy()
            a[step:] *= a[:-step].copy()
            step *= 2
        return a, b

    def transfer(self, x: np.ndarray) -> tuple[float, float]:
        a, b = self._maps(x)
        return float(a[-1]), float(b[-1])

    def carried(self, state: float, transfer: tuple[float, float]) -> float:
        return transfer[0] * state + transfer[1]

    def run(self, state: float | None, x: np.ndarray) -> tuple[list[np.ndarray], float]:
        a, b = self._maps(x)
        found = a * (x[0] if state is None else state) + b
        if state is None:
            found[0] = x[0]
        return [found], float(found[-1])


class QualityModes:
    """Four modes with counters against flutter, of grades 2 (fine), 1 (poor) and 0 (blind).

    Only the run of the present grade counts: its length, and the mode in which it began. A run is a
    map of modes, and runs compose to one.
    """

    outputs = "mode string, run long"
    MODES = np.array(["GOOD", "DEGRADED", "LOST", "RECOVERING"], dtype=object)
    # Rows until a change counts, by grade; the mode it then has.
    ROWS, THEN = np.array([10, 5, 20]), np.array([2, 1, 0])

    def _after(self, grade: np.ndarray, n: np.ndarray, mode: np.ndarray) -> np.ndarray:
        """The mode at the n-th row of a run that began in `mode`."""
        until = np.where((grade == 2) & (mode != 0), 3, mode)
        return np.where((n >= self.ROWS[grade]) & ((grade != 2) | (mode != 0)), self.THEN[grade], until)

    def _runs(self, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate(([True], grade[1:] != grade[:-1])))
        return begin, np.diff(np.append(begin, len(grade)))

    def transfer(self, grade: np.ndarray) -> tuple:
        """First run (grade, rows); the map of modes of the runs between it and the last; last run, None where it is the first."""
        begin, n = self._runs(grade)
        mode = np.arange(4)
        for g, k in zip(grade[begin][1:-1], n[1:-1], strict=True):
            mode = self._after(np.full(4, g), np.full(4, k), mode)
        return (int(grade[0]), int(n[0])), mode.tolist(), (int(grade[-1]), int(n[-1])) if len(n) > 1 else None

    def carried(self, state: tuple[int, int, int], transfer: tuple) -> tuple[int, int, int]:
        (g0, n0), modes, last = transfer
        grade, n, mode = state
        if g0 == grade:
            n += n0
        else:
            mode, grade, n = int(self._after(np.array([grade]), np.array([n]), np.array([mode]))[0]), g0, n0
        if last is None:
            return grade, n, mode
        ended = int(self._after(np.array([grade]), np.array([n]), np.array([mode]))[0])
        return (*last, modes[ended])

    def run(self, state: tuple[int, int, int] | None, grade: np.ndarray) -> tuple[list[np.ndarray], tuple[int, int, int]]:
        grade = grade.astype(np.int64)
        begin, n = self._runs(grade)
        place = np.arange(len(grade)) - np.repeat(begin, n) + 1
        mode, before = 0, 0
        if state is not None:
            if state[0] == grade[0]:
                before, mode = state[1], state[2]
                place[: n[0]] += before
            else:
                mode = int(self._after(*(np.array([x]) for x in state))[0])
        begun = []
        for g, k in zip(grade[begin].tolist(), n.tolist(), strict=True):
            begun.append(mode)
            k += before
            before = 0
            mode = (0 if mode == 0 or k >= 20 else 3) if g == 2 else (self.THEN[g] if k >= self.ROWS[g] else mode)
        modes = np.repeat(np.array(begun), n)
        last = (int(grade[-1]), int(place[-1]), int(begun[-1]))
        return [self.MODES[self._after(grade, place, modes)], place], last


def quality_modes(rows: DataFrame, available: Column, accuracy: Column, satellites: Column | None = None) -> DataFrame:
    """KEY, ORDER, mode, score, trust, ai_active and skip_gnss: fixes are scored by accuracy and satellites, and modes change only after several rows of a grade."""
    few = F.lit(1.0) if satellites is None else F.when(satellites < 6, 0.7).otherwise(1.0)
    known = available & accuracy.isNotNull() & ~F.isnan(accuracy)
    value = F.when(~F.coalesce(known, F.lit(False)) | (accuracy >= 50), 0.0).when(accuracy <= 10, 1 - 0.2 * accuracy / 10).when(accuracy <= 25, 0.8 - 0.6 * (accuracy - 10) / 15).otherwise(F.greatest(F.lit(0.0), 0.2 * (1 - (accuracy - 25) / 25)))
    scored = rows.withColumn("score", value * few).withColumn("_grade", F.when(F.col("score") >= 0.7, 2).when(F.col("score") >= 0.2, 1).otherwise(0))
    found = scanned(scored, QualityModes(), ["_grade"], (ORDER, "score"))
    mode, score = F.col("mode"), F.col("score")
    fine = F.when(score >= 0.7, F.col("run")).otherwise(0)
    trust = F.when(mode == "GOOD", 1.0).when(mode == "LOST", 0.0).when(mode == "DEGRADED", F.greatest(F.lit(0.1), score)).otherwise(0.2 + 0.8 * F.least(F.lit(1.0), F.greatest(F.lit(0.1), fine / 20)))
    return found.select(KEY, ORDER, "mode", "score", trust.alias("trust"), (mode != "GOOD").alias("ai_active"), (mode == "LOST").alias("skip_gnss"))


def _asof(rows: DataFrame, at: Column, due: Column, strict: bool, allowed: Column) -> DataFrame:
    """KEY, ORDER and `to`: the first allowed row, later in order, whose `at` has reached (`strict`: passed) this row's `due`. `at` must not fall along a session."""
    targets = rows.where(allowed & at.isNotNull()).select(KEY, at.alias("_v"), F.lit(0 if strict else 1).alias("_kind"), F.col(ORDER).alias("_to"), F.lit(None).cast("long").alias("_of"))
    queries = rows.where(due.isNotNull()).select(KEY, due.alias("_v"), F.lit(1 if strict else 0), F.lit(None).cast("long"), F.col(ORDER).cast("long"))
    back = W.partitionBy(KEY).orderBy(F.desc("_v"), F.desc("_kind"), F.desc("_to")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = targets.union(queries).withColumn("_first", F.last("_to", ignorenulls=True).over(back)).where("_of IS NOT NULL").select(KEY, F.col("_of").alias(ORDER), "_first")
    later = W.partitionBy(KEY).orderBy(F.desc(ORDER)).rowsBetween(W.unboundedPreceding, -1)
    follows = rows.select(KEY, ORDER, F.last(F.when(allowed & at.isNotNull(), F.col(ORDER)), ignorenulls=True).over(later).alias("_next"))
    joined = follows.join(reached, follows[KEY].eqNullSafe(reached[KEY]) & (follows[ORDER] == reached[ORDER])).select(follows[KEY], follows[ORDER], "_first", "_next")
    return joined.where("_first IS NOT NULL AND _next IS NOT NULL").select(KEY, ORDER, F.greatest("_first", "_next").alias("to"))


def reached_from(starts: DataFrame, successors: DataFrame) -> DataFrame:
    """KEY and ORDER of all rows on the paths that begin at `starts` and follow `to` of `successors` (KEY, ORDER, to): jumps are doubled each round."""
    names = [KEY, ORDER]
    found, jumps = cut(starts.select(*names)), cut(successors)
    while True:
        hop = jumps.select(F.col(KEY).alias("_k"), F.col(ORDER).alias("_o"), F.col("to").alias("_t"))
        new = found.join(hop, found[KEY].eqNullSafe(F.col("_k")) & (found[ORDER] == F.col("_o"))).select(KEY, F.col("_t").alias(ORDER))
        more = cut(found.union(new).distinct())
        if more.count() == found.count():
            return found
        found = more
        jumps = cut(jumps.join(hop, jumps[KEY].eqNullSafe(F.col("_k")) & (jumps["to"] == F.col("_o"))).select(KEY, ORDER, F.col("_t").alias("to")))


def marked(rows: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """`rows` with whether each is among `chosen` (KEY, ORDER)."""
    there = chosen.select(F.col(KEY).alias("_k"), F.col(ORDER).alias("_o"), F.lit(True).alias(name))
    return rows.join(there, rows[KEY].eqNullSafe(F.col("_k")) & (rows[ORDER] == F.col("_o")), "left").drop("_k", "_o").withColumn(name, F.coalesce(name, F.lit(False)))


def thinned(rows: DataFrame, time: str, interval: float) -> DataFrame:
    """`rows` with `emitted`: a session's first row, and each that is `interval` or more after the last one emitted.

    Only rows that are later than all before can be emitted, so a clock that jumps back does no harm.
    A null time is never emitted.
    """
    w = W.partitionBy(KEY).orderBy(ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    timed = cut(rows.withColumn("_at", F.max(time).over(w)).withColumn("_start", F.first(F.when(F.col(time).isNotNull(), F.col(ORDER)), ignorenulls=True).over(w)))
    known = F.col(time).isNotNull()
    successors = _asof(timed, F.col("_at"), F.col("_at") + interval, False, known)
    starts = timed.where(F.col("_start") == F.col(ORDER))
    return marked(timed, reached_from(starts, successors), "emitted").drop("_at", "_start")


def reanchored(rows: DataFrame, time: str, interval: Column, available: Column) -> DataFrame:
    """`rows` with `is_reset`: the last row before one that is more than the interval after the last reset, if it has a fix.

    The first interval runs from the session's first row; each further one is the `interval` of the
    row that was reset (draw it from a hash of session, row and seed). Times must rise.
    """
    w = W.partitionBy(KEY).orderBy(ORDER)
    timed = cut(rows.withColumns({"_due": F.col(time) + interval, "_next_at": F.lead(time).over(w), "_ok": F.coalesce(available, F.lit(False)), "_n": F.row_number().over(w)}))
    successors = cut(_asof(timed, F.col("_next_at"), F.col("_due"), True, F.col("_ok")))
    # the first row may itself be the first reset; later ones follow the row they are counted from
    first = timed.where("_n = 1")
    own = first.where(F.col("_ok") & (F.col("_next_at") > F.col("_due"))).select(KEY, ORDER)
    other = first.where(~F.coalesce(F.col("_ok") & (F.col("_next_at") > F.col("_due")), F.lit(False))).select(F.col(KEY).alias("_k"), F.col(ORDER).alias("_o"))
    begun = successors.join(other, successors[KEY].eqNullSafe(F.col("_k")) & (successors[ORDER] == F.col("_o"))).select(KEY, F.col("to").alias(ORDER))
    return marked(timed, reached_from(own.union(begun), successors), "is_reset").drop("_due", "_next_at", "_ok", "_n")
