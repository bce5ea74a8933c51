"""Reproducible global shuffle and sharding with DataFrame and SQL functions only.

Rows get global numbers 0..n-1 in a stated order; a Feistel permutation with cycle walking maps each
number to its place in the shuffle; shard and slot are that place modulo and divided by the shards.
Both directions can be computed from the number alone, without a shuffled copy of the data.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut

#: Modulus and multiplier of the round function: the prime 2^31 - 1 and a primitive root of it.
PRIME, ROOT = 2147483647, 48271


def radices(n: int, walk: int) -> tuple[int, int]:
    """(a, b) with n <= a * b < n + walk, both near the root of n.

    At most `walk` - 1 numbers below a * b lie outside 0..n-1, so a walk from inside is back inside
    within `walk` steps: the walk can be written out and always ends.
    """
    a = isqrt(max(n - 1, 0)) + 1
    while -n % a >= walk:
        a += 1
    return a, -(-n // a)


def round_keys(seed: int, rounds: int) -> list[int]:
    keys, x = [], seed % PRIME
    for _ in range(2 * rounds):
        x = (x * ROOT + 11) % PRIME
        keys.append(x)
    return keys


def permuted(number: str, n: int, seed: int = 1, rounds: int = 4, walk: int = 64) -> Column:
    """The place of row `number` (a column of 0..n-1) in the shuffle; one to one on 0..n-1."""
    a, b = radices(n, walk)
    keys = round_keys(seed, rounds)
    pairs = ", ".join(f"named_struct('p', {p}L, 'q', {q}L)" for p, q in zip(keys[::2], keys[1::2], strict=True))

    def mixed(x: str, key: str) -> str:
        square = f"((({x} + {key}) % {PRIME}L) * (({x} + {key}) % {PRIME}L) % {PRIME}L)"
        return f"(({square} * {ROOT}L + {key}) % {PRIME}L)"

    left = f"((s.l + {mixed('s.r', 'k.p')}) % {a}L)"
    right = f"((s.r + {mixed(left, 'k.q')}) % {b}L)"

    def once(x: str) -> str:
        return f"aggregate(array({pairs}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, k) -> named_struct('l', {left}, 'r', {right}), s -> s.l * {b}L + s.r)"

    return F.expr(f"aggregate(sequence(1, {walk}), {once(number)}, (v, i) -> CASE WHEN v < {n}L THEN v ELSE {once('v')} END)")


def number_rows(rows: DataFrame, order_by: list[str]) -> tuple[DataFrame, int]:
    """(`rows` with a column `_number`, their count): global numbers from 0 in the order of `order_by`.

    A range shuffle, with an arrival number as last key so that a hot key is spread over tasks, and
    one sum over as many rows as there are partitions. Rows equal in all of `order_by` are numbered
    among themselves in any order.
    """
    sorted_rows = rows.withColumn("_arrival", F.monotonically_increasing_id()).repartitionByRange(*order_by, "_arrival").sortWithinPartitions(*order_by, "_arrival").drop("_arrival")
    placed = cut(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_in_part": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.selectExpr("_part", "sum(_size) OVER (ORDER BY _part) - _size AS _start")
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()["n"]
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("_number", F.col("_start") + F.col("_in_part"))
    return numbered.drop("_part", "_in_part", "_start"), total


def shard_rows(rows: DataFrame, n_shards: int, order_by: list[str], *, seed: int = 1, rounds: int = 4) -> DataFrame:
    """Add shard int and slot long: counts of shards differ by one at most, slots have no gaps.

    `rows` is written once to the checkpoint folder: give it the columns you need. Columns whose
    names begin with `_`, shard and slot are reserved, an error otherwise. Null keys sort first, repeated rows get places of their own,
    an empty table stays empty.
    """
    if taken := [c for c in rows.columns if c.startswith("_") or c.lower() in ("shard", "slot")]:
        raise ValueError(f"reserved column names: {taken}")
    numbered, n = number_rows(rows, order_by)
    place = permuted("_number", max(n, 1), seed, rounds)
    return numbered.withColumn("_place", place).withColumns({"shard": (F.col("_place") % n_shards).cast("int"), "slot": F.expr(f"_place div {n_shards}L")}).drop("_number", "_place")


def shard_documents(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Digest of the sharding of documents: doc_id, size (bytes + 1), text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes. The law is `rows`. Other columns of `docs` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = shard_rows(narrow, n_shards, ["doc_id", "text_crc32", "size"], seed=seed)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
