"""Merkle manifest of a dataset by parent-preimage paths.

Each inner node stores its preimage: the digests of its up to 16 children, 64 characters each, in
order. A node's digest is the sha256 of its preimage, so a row of a level holds all that its children
need of it. Levels are built upwards by one grouping each, a sixteenth of the rows a time; paths go
downwards the same way: a child takes its parent's path and puts the parent's preimage, with its own
slot there, in front. No group has more than 16 members, whatever the size of a source.

A leaf proves itself by its path: cut its 64-character slot out of the first preimage and what is left
are its siblings there; put a digest into the slot and the hash is the parent's, which goes into the
next slot, up to the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lower_az, written
from waymark.llm.groups import PLACE, SIZE, numbered, placed

#: Children of a node, and characters of a digest.
FAN, DIGEST = 16, 64
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "CAST(array() AS array<struct<preimage: string, slot: int>>)"


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and value; it tells values apart whatever they contain."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    """Lower-case hex sha256 of inputs joined together."""
    return F.sha2(F.concat(*inputs), 256)


def leaf_of(values: list[Column]) -> Column:
    return digest(*map(field, values))


def spliced(path: Column, child: Column) -> Column:
    """The preimage of a path step with `child` in its slot."""
    begin = path["slot"] * DIGEST
    return F.concat(F.substring(path["preimage"], F.lit(1), begin), child, F.substring(path["preimage"], begin + DIGEST + 1, F.lit(FAN * DIGEST)))


def proof_of(path: Column) -> Column:
    """sha256 of the siblings on a path, from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda p: spliced(p, F.lit(""))), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(spliced(p, h), 256))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels over (tree, place, size, hash), that one first: inner nodes have their preimage; size is the tree's nodes on that level.

    A tree that has one node on a level has no nodes above it.
    """
    found = [leaves.withColumn("preimage", F.lit(None).cast("string"))]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        at = F.expr(f"place div {FAN}")
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))
        grouped = found[-1].where("size > 1").groupBy("tree", at.alias("place")).agg(F.array_join(F.transform(children, lambda c: c["hash"]), "").alias("preimage"), F.expr(f"first((size + {FAN - 1}) div {FAN})").alias("size"))
        found.append(written(grouped.select("tree", "place", "size", F.sha2("preimage", 256).alias("hash"), "preimage")))
        most = -(-most // FAN)
    return found


def descended(up: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level, all its columns, with `path`, an array of (preimage, slot) from its parent to the root, and `top`, its tree's digest; `above` has tree and the path of each tree's own digest."""
    tops = above.select(F.col("tree").alias("_t"), F.col("path").alias("_path"))

    def crowned(level: DataFrame) -> DataFrame:
        one = level.where("size = 1")
        return one.join(tops, F.col("tree").eqNullSafe(F.col("_t"))).select(*level.columns, F.col("_path").alias("path"), F.col("hash").alias("top"))

    found = crowned(up[-1])
    for level in up[-2::-1]:
        parents = found.select(F.col("tree").alias("_t"), F.col("place").alias("_q"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), "top")
        children = level.where("size > 1").join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.expr(f"place div {FAN}") == F.col("_q")))
        step = F.struct(F.col("_preimage").alias("preimage"), (F.col("place") % FAN).cast("int").alias("slot"))
        below = children.select(*level.columns, F.concat(F.array(step), "_path").alias("path"), "top")
        found = below.unionByName(crowned(level))
    return found


@dataclass
class Manifest:
    """Levels of the source trees (leaves first), levels of the tree over them (subroots first, their tree being 0), and the root; None without rows."""

    sources: list[DataFrame]
    dataset: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """Every inner node: kind (source or dataset), tree, level from 1, place, hash and preimage; what to keep beside a dataset."""
        parts = [level.select(F.lit(kind).alias("kind"), F.col("tree").cast("string").alias("tree"), F.lit(n).alias("level"), "place", "hash", "preimage") for kind, up in (("source", self.sources), ("dataset", self.dataset)) for n, level in enumerate(up) if n]
        found = self.sources[0].select(F.lit("source").alias("kind"), F.col("tree").cast("string").alias("tree"), F.lit(0).alias("level"), "place", "hash", "preimage").where("false")
        for part in parts:
            found = found.unionByName(part)
        return found

    def paths(self) -> DataFrame:
        """The leaves, all their columns (source is tree), with top (subroot) and path to the root."""
        down = descended(self.dataset, self.dataset[-1].where("size = 1").selectExpr("tree", f"{NO_PATH} AS path"))
        return descended(self.sources, down.select(F.col("source").alias("tree"), "path")).drop("preimage")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of (source, place, size, hash) and any other columns: a tree for each source, one over all of them, in order of source (null first, then by bytes)."""
    sources = levels(leaves.withColumnRenamed("source", "tree"))
    tops = [level.where("size = 1").select(F.col("tree").alias("source"), "hash") for level in sources]
    ordered = written(numbered(reduce(DataFrame.unionByName, tops), ["source"]).withColumnRenamed(PLACE, "place"))
    n = ordered.count()
    dataset = levels(ordered.select(F.lit(0).alias("tree"), "place", F.lit(n).cast("long").alias("size"), "hash", "source"))
    root = dataset[-1].first()
    return Manifest(sources, dataset, root["hash"] if root else None)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`, which has doc_id, source, lang, n_chars and text.

    Leaves of a source ascend by doc_id (null first), those of one doc_id by digest, so repeated rows
    have places of their own. Null values hash as `-`, an empty text as `0:`. A row is tampered with
    (its text's A-Z lower-cased) where 5 divides the crc32 of its decimal doc_id, so never without an
    id; verified tells whether the leaf it then has still leads to the root. A single row is its own
    root with no siblings; no rows give none. Other columns of `docs` are not read.
    """
    values = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of([*values[:-1], lower_az(F.col("text"))]))
    leaves = written(docs.select("doc_id", "source", leaf_of(values).alias("hash"), tampered.alias("_tampered")))
    rows = written(placed(leaves, "source", ["doc_id", "hash"]).withColumnsRenamed({PLACE: "place", SIZE: "size"}))
    manifest = build(rows)
    root = F.lit(manifest.root).cast("string")
    found = manifest.paths().select("doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), proof_of(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("_tampered", "hash")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
