"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A query is a sparse row of weighted terms (dimension, weight). For a block of stored vectors, each
term's postings are scattered, weighted, into dense score arrays; a partition step picks the k best
of the block, and the blocks' bests are merged. Integers throughout, so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores held at once by a task: queries x vectors.
SCORE_CELLS = 2_000_000
NONE = np.iinfo(np.int64).min
#: Scores whose sum of absolute products stays below this need no care; a score must fit in a long.
SAFE, LONG = float(1 << 62), float(1 << 63)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """_id and _terms (floor(scale * x), x as double; whole numbers held as doubles), without null ids and unusable vectors.

    Unusable: null, or with a component that is null or not finite.
    """
    given = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    usable = F.forall("_given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("_id"), given.alias("_given")).where(F.col("_id").isNotNull() & F.col("_given").isNotNull() & usable)
    exact = float(1 << 53)  # doubles beyond this are whole
    return rows.select("_id", F.transform("_given", lambda x: F.when(F.abs(x * scale) < exact, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("_terms"))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the nonzero components of a list column, by term; weights are whole doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((row, term))
    order = order[flat[order] != 0]
    return row[order], term[order], flat[order]


def wrapped(weight: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, modulo 2 ** 64."""
    if not len(weight) or np.abs(weight).max() < LONG:
        return weight.astype(np.int64)
    size = np.fmod(np.where(np.isfinite(weight), np.abs(weight), 0.0), 2 * LONG).astype(np.uint64)
    return np.where(weight < 0, np.uint64(0) - size, size).view(np.int64)


def largest(weight: np.ndarray) -> float:
    return float(np.abs(weight).max()) if len(weight) else 0.0


def by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Postings: term to (rows, weights)."""
    terms, first = np.unique(term, return_index=True)
    last = [*first[1:], len(term)]
    return {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(terms, first, last, strict=True)}


def accumulate(n_queries: int, n_rows: int, queries: dict, postings: dict, kind: type = np.int64) -> np.ndarray:
    """Dense scores, a term at a time; integers are taken modulo 2 ** 64."""
    scores = np.zeros((n_queries, n_rows), dtype=kind)
    for term, (rows, weights) in postings.items():
        if term in queries:
            asking, wanted = queries[term]
            if len(asking) == n_queries and len(rows) == n_rows:
                scores += np.multiply.outer(wanted, weights)
            else:
                scores[np.ix_(asking, rows)] += np.multiply.outer(wanted, weights)
    return scores


def exact_scores(n_queries: int, n_rows: int, asked: tuple, stored: tuple, wanted: np.ndarray) -> np.ndarray:
    """Scores of any finite components, from (row, term, weight) of both; an error where a `wanted` one exceeds a long.

    Sums modulo 2 ** 64 are right wherever the true score fits; that is judged by sums of doubles
    with their error bound, and pairs too near to judge are added up in whole numbers.
    """
    sides = [(row, term, wrapped(weight), weight, np.abs(weight)) for row, term, weight in (asked, stored)]
    with np.errstate(over="ignore", invalid="ignore"):
        scores, about, size = (accumulate(n_queries, n_rows, *(by_term(*side[:2], side[i]) for side in sides), kind=kind) for i, kind in ((2, np.int64), (3, np.float64), (4, np.float64)))
        terms = 2 + len(np.unique(stored[1]))
        sure = np.abs(about) + size * terms * 2.0**-51 < LONG
    for q, r in zip(*np.nonzero(wanted & ~sure), strict=True):
        one, other = (dict(zip(term[row == at].tolist(), weight[row == at].tolist(), strict=True)) for (row, term, weight), at in ((asked, q), (stored, r)))
        score = sum(int(w) * int(other[t]) for t, w in one.items() if t in other)
        if not NONE < score < -NONE:
            raise OverflowError(f"a score does not fit in a long: {float(score):g}")
        scores[q, r] = score
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to smaller ids; columns stand in the order of ids."""
    if scores.shape[1] > k:
        bar = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, level = scores > bar, scores == bar
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        at = np.nonzero(above | level)[1].reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.take_along_axis(scores, at, axis=1), ids[at]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = (np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def exact_topk(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` best rows for every row where `is_query` holds.

    Scores that do not fit in a long are an error. Every usable row but those with the query's own id is scored (see `quantised`); missing
    dimensions count as 0. All queries take part: they go out in blocks of about `block_rows`, each
    small enough to broadcast, and each block scans all rows. Ids must be whole numbers. Repeated
    rows are results of their own; a repeated query row is answered once.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    queries = quantised(vectors.where(is_query), id_col, vec_col, scale).distinct()
    blocks = max(1, -(-queries.count() // block_rows))
    number = F.pmod(F.xxhash64("_id", "_terms"), F.lit(blocks))

    def block(i: int) -> DataFrame:
        asked = queries.where(number == i).toArrow()
        asked_ids = asked.column("_id").to_numpy().astype(np.int64)
        shipped = spark.sparkContext.broadcast((asked_ids, matrix(asked.column("_terms"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, asked = shipped.value
            n, terms = len(query_ids), by_term(*asked[:2], wrapped(asked[2]))
            most = largest(asked[2])
            if not n:
                return
            held = np.empty((n, 0), np.int64), np.empty((n, 0), np.int64)
            step = max(1, SCORE_CELLS // n)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    order = np.argsort(ids, kind="stable")
                    part, ids = part.take(pa.array(order)), ids[order]
                    stored = matrix(part.column(1))
                    lo, hi = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
                    wanted = np.ones((n, len(ids)), dtype=bool)
                    for q in np.flatnonzero(lo < hi):
                        wanted[q, lo[q] : hi[q]] = False
                    dimensions = 1 + int(stored[1].max(initial=0))
                    if dimensions * most * largest(stored[2]) < SAFE and max(most, largest(stored[2])) < SAFE:
                        scores = accumulate(n, len(ids), terms, by_term(*stored[:2], wrapped(stored[2])))
                    else:
                        scores = exact_scores(n, len(ids), asked, stored, wanted)
                    scores[~wanted] = NONE
                    held = merge(held, best(scores, ids, k), k)
            scores, ids = held
            asking = np.repeat(np.arange(n), scores.shape[1])
            keep = scores.ravel() != NONE
            columns = (asking[keep].astype(np.int32), query_ids[asking][keep], ids.ravel()[keep], scores.ravel()[keep])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_query", "query_id", "vec_id", "score"])

        return rows.mapInArrow(scan, "_query int, query_id long, vec_id long, score long").withColumn("_block", F.lit(i))

    found = reduce(DataFrame.unionByName, [block(i) for i in range(blocks)])
    order = W.partitionBy("query_id", "_block", "_query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
