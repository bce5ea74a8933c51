"""Log weights of the moves between the candidates of neighbouring rows: arrays of a row in numpy, never a row for each move.

The node pairs whose route a row asks for are one list; equal lists of many rows are one, and only
their pairs are looked up among the lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from waymark.functions.checkpoints import written
from waymark.operators.nearest import ids_as_ranks, numbers
from waymark.operators.trips import KEY, ORDER

#: Rows whose moves are worked on together.
ROWS = 1000


def weighed(rows: DataFrame, lengths: Callable[[DataFrame], DataFrame], weigh: Callable[..., np.ndarray], *, emissions: Column, numbers_of: dict[str, Column], lagged: list[str], radius: float, backward_m: float, backward_factor: float, two_way: bool = False, same_edge: bool = False) -> DataFrame:
    """KEY, ORDER, `emissions` and `moves` (see `viterbi`) of rows with `options`.

    `lengths` gives source, target and metres of the distinct pairs asked for. Along one edge a move
    goes forwards, or backwards by less than `backward_m` at a factor (with `two_way` by any length
    where an option is not oneway); else to the end of the one edge, over the graph, and on from the
    start of the other, also on one edge with `same_edge`. `weigh` takes (route, straight, same) of
    the moves, route no number where there is none, and a dict of `numbers_of`, columns of the row and of
    its columns `lagged` before as `was_<c>`.
    """
    w = W.partitionBy(KEY).orderBy(ORDER)
    both = rows.withColumns({f"was_{c}": F.lag(c).over(w) for c in ("options", *lagged)})

    def pair(a: Column, b: Column) -> Column:
        ahead = b["offset_m"] - a["offset_m"]
        goes = (ahead >= 0) | (-ahead < backward_m)
        if two_way:
            goes = goes | F.coalesce(~a["oneway"], F.lit(False))
        own = F.coalesce((a["edge_id"] == b["edge_id"]) & (goes if same_edge else F.lit(True)), F.lit(False))
        return F.when(~own & a["to_node"].isNotNull() & b["from_node"].isNotNull(), F.struct(a["to_node"].cast("long").alias("source"), b["from_node"].cast("long").alias("target")))

    every = F.flatten(F.transform("was_options", lambda a: F.transform("options", lambda b: pair(a, b))))
    asked = written(both.withColumn("_pairs", F.array_sort(F.array_distinct(F.array_compact(every)))).withColumn("_named", F.xxhash64("_pairs")).drop("was_options"))
    lists = written(asked.where(F.size("_pairs") > 0).select("_named", "_pairs").distinct().withColumn("_list", F.monotonically_increasing_id()))
    each = written(lists.select("_list", F.explode("_pairs").alias("p")).select("_list", "p.source", "p.target"))
    metres = lengths(each.select("source", "target").distinct())
    told = each.join(metres.where("metres IS NOT NULL"), ["source", "target"]).groupBy("_list").agg(F.collect_list(F.struct("source", "target", "metres")).alias("_known"))
    answers = written(lists.join(told, "_list").select("_named", "_pairs", "_known"))
    # the options before once more, as what was written has them once
    whole = asked.join(answers, ["_named", "_pairs"], "left").withColumn("was_options", F.lag("options").over(w))
    ready = whole.select(KEY, ORDER, emissions.alias("emissions"), "options", "was_options", "_known", *(c.cast("double").alias(n) for n, c in numbers_of.items()))
    extra = list(numbers_of)
    schema = StructType([*(ready.schema[c] for c in (KEY, ORDER, "emissions")), StructField("moves", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                moves = _moves(part, extra, weigh, radius, backward_m, backward_factor, two_way, same_edge)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (KEY, ORDER, "emissions")), moves], names=[KEY, ORDER, "emissions", "moves"])

    return ready.mapInArrow(run, schema)


def _moves(rows: pa.RecordBatch, extra: list[str], weigh: Callable[..., np.ndarray], radius: float, backward_m: float, backward_factor: float, two_way: bool, same_edge: bool) -> pa.ListArray:
    lists = [rows.column(c) for c in ("was_options", "options", "_known")]
    was, now, known = (x.flatten() for x in lists)
    n_was, n_now, n_known = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    n = n_was * n_now
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a = (np.cumsum(n_was) - n_was)[row] + inner // np.maximum(n_now[row], 1)
    b = (np.cumsum(n_now) - n_now)[row] + inner % np.maximum(n_now[row], 1)

    def of(options: pa.StructArray, name: str, at: np.ndarray) -> np.ndarray:
        return numbers(options.field(name))[at]

    edges = pa.chunked_array([was.field("edge_id"), now.field("edge_id")]).combine_chunks()
    ranks, named = ids_as_ranks(edges), edges.is_valid().to_numpy(zero_copy_only=False)
    same = (ranks[a] == ranks[len(was) + b]) & named[a] & named[len(was) + b]
    begun, ended = of(was, "offset_m", a), of(now, "offset_m", b)
    ahead = ended - begun
    back = np.where(-ahead < backward_m, -ahead * backward_factor, np.nan)
    if two_way:
        oneway = pc.fill_null(was.field("oneway"), True).to_numpy(zero_copy_only=False)
        back = np.where(oneway[a], back, -ahead)
    own = np.where(same, np.where(ahead >= 0, ahead, back), np.nan)

    source, target = _nodes(was.field("to_node"), a), _nodes(now.field("from_node"), b)
    told_source, told_target = _nodes(known.field("source"), slice(None)), _nodes(known.field("target"), slice(None))
    nodes, codes = np.unique(np.concatenate((source, target, told_source, told_target)), return_inverse=True)
    s, t, ks, kt = np.split(codes, np.cumsum([len(source), len(target), len(told_source)]))
    place = (np.repeat(np.arange(len(n)), n_known) * len(nodes) + ks) * len(nodes) + kt
    order = np.argsort(place)
    place, metres = place[order], np.append(numbers(known.field("metres"))[order], np.nan)
    wanted = (row * len(nodes) + s) * len(nodes) + t
    found = np.searchsorted(place, wanted)
    hit = np.append(place, -1)[found] == wanted
    null = was.field("to_node").is_null().to_numpy(zero_copy_only=False)[a] | now.field("from_node").is_null().to_numpy(zero_copy_only=False)[b]
    over = np.where(hit & ~null, metres[found], np.nan)
    around = np.maximum(0.0, of(was, "length_m", a) - begun) + over + np.maximum(0.0, ended)
    route = np.where(np.isnan(own), around if same_edge else np.where(same, np.nan, around), own)
    straight = haversine(of(was, "proj_lat", a), of(was, "proj_lng", a), of(now, "proj_lat", b), of(now, "proj_lng", b), radius)
    with np.errstate(all="ignore"):
        moves = weigh(route, straight, same, {c: numbers(rows.column(c))[row] for c in extra})
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(moves))


def _nodes(ids: pa.Array, at: np.ndarray | slice) -> np.ndarray:
    return pc.fill_null(pc.cast(ids, pa.int64()), 0).to_numpy(zero_copy_only=False)[at]


def haversine(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray, radius: float) -> np.ndarray:
    """Great-circle distance."""
    half_lat, half_lng = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lng * half_lng
    return 2 * radius * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
