"""Prefix trie of conversations from a Cartesian tree over the LCP array of the sorted conversations.

1. Conversations are sorted as sequences of turns. A sequence is cut into blocks of 64 turns, distinct
   blocks are sorted and get their rank for a name, the ranks are cut into blocks of 64 again, and so
   on until one block is a whole conversation. Ranks keep the order, so the top blocks sort as the
   sequences do, and no row ever holds more than 64 names, however long a conversation is. Equal
   conversations are one sequence with a weight.
2. The common prefix of neighbours (LCP) is found from the top blocks down: where two differ, the two
   blocks named there are fetched and compared.
3. All nearest smaller values of the LCP array are found in parallel: each block of positions finds
   those inside it, and by the least LCP of every block (at most 65536 numbers, the blocks grow with
   the table) the block where each other one lies, which is then asked. A position with its nearest
   smaller values on both sides is a node of the Cartesian tree: an interval of sequences and a depth.
   Equal LCPs within an interval are merged: one node of the trie, as deep as its children share.
4. Depths that no LCP names have one child; they are written out between a node and its parent.
   Counts and sums of a subtree are differences of running sums at the ends of its interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, written
from waymark.llm.groups import BEFORE, PLACE, SIZE, numbered, placed

#: Names of a block, least positions of a block of the LCP array, and most such blocks.
NAMES, POSITIONS, MOST_BLOCKS = 64, 1024, 1 << 16
#: Members of a node whose ids are joined in one row.
IDS = 4096
NONE = np.iinfo(np.int64).max
SUMS = ("w", "all_chars", "new_chars", "leaf")


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, depth from 1, key, before (code points of the turns before); and conv_id, length, chars.

    Conversation c begins with the first h turns of conversation c - c % `every`, h being crc32(c) %
    `heads`, and goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))
    own = written(placed(rows, "conv_id", ["turn", "key"], "chars"))
    chars_of = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    first = own.where(F.col(PLACE) < heads - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(PLACE, "key", "chars"))).alias("head"), F.first(SIZE).alias("n"))
    bases = first.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_b"), F.col("head").alias("_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    begun = first.withColumn("h", h).join(bases, F.col("conv_id") - F.col("conv_id") % every == F.col("_b"), "left")
    none = F.slice(F.col("head"), F.lit(1), F.lit(0))
    begun = begun.withColumn("taken", F.when(F.col("h") > 0, F.coalesce(F.slice("_base", F.lit(1), F.col("h")), none)).otherwise(none))
    convs = written(begun.select("conv_id", "h", "n", "taken", chars_of(F.col("taken")).alias("taken_chars"), F.when(F.col("h") > 0, chars_of(F.slice("head", F.lit(1), F.col("h")))).otherwise(0).alias("left_chars")))
    tail = own.join(convs, "conv_id").where(F.col(PLACE) >= F.col("h"))
    turns = tail.select("conv_id", (F.size("taken") + F.col(PLACE) - F.col("h") + 1).alias("depth"), "key", (F.col("taken_chars") + F.col(BEFORE) - F.col("left_chars")).alias("before"), "chars")
    begin = convs.select("conv_id", "taken", F.posexplode("taken").alias("at", "t"))
    turns = turns.unionByName(begin.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.key", chars_of(F.expr("slice(taken, 1, at)")).alias("before"), "t.chars"))
    turns = written(turns)
    total = turns.groupBy("conv_id").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("length"))
    lengths = written(convs.select("conv_id").join(total, "conv_id", "left").na.fill(0, ["chars", "length"]))
    discard(own)
    discard(convs)
    return turns, lengths


def named_blocks(turns: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id and its top block `items`; for each level of blocks below, from the lowest: rank and items)."""
    dictionaries: list[DataFrame] = []
    items, n = turns.select("conv_id", (F.col("depth") - 1).alias("at"), F.col("key").alias("item")), longest
    while True:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"])
        blocks = items.groupBy("conv_id", F.expr(f"at div {NAMES}").alias("block")).agg(inside.alias("items"))
        n = -(-n // NAMES)
        if n <= 1:
            return blocks.select("conv_id", "items"), dictionaries
        blocks = written(blocks)
        dictionaries.append(written(numbered(blocks.select("items").distinct(), ["items"]).withColumnRenamed(PLACE, "rank")))
        items = written(blocks.join(dictionaries[-1], "items").select("conv_id", F.col("block").alias("at"), F.col("rank").alias("item")))


def neighbours_lcp(sequences: DataFrame, dictionaries: list[DataFrame]) -> DataFrame:
    """at and lcp (turns in common with the sequence before) of every sequence but the first."""
    before = sequences.select((F.col("at") + 1).alias("at"), F.col("items").alias("x"))
    pairs = sequences.select("at", F.col("items").alias("y")).join(before, "at").withColumn("lcp", F.lit(0).cast("long"))
    done = None
    for level in range(len(dictionaries), -1, -1):
        same = F.zip_with("x", "y", lambda p, q: p.eqNullSafe(q))
        pairs = pairs.withColumn("j", F.array_position(same, F.lit(False)).cast("int")).withColumn("lcp", F.col("lcp") + (F.col("j") - 1) * NAMES**level)
        if not level:
            ended = pairs.select("at", "lcp")
        else:
            pairs = written(pairs.select("at", "lcp", F.get("x", F.col("j") - 1).alias("p"), F.get("y", F.col("j") - 1).alias("q")))
            ended = pairs.where("p IS NULL OR q IS NULL").select("at", "lcp")
            named = [dictionaries[level - 1].select(F.col("rank").alias(r), F.col("items").alias(c)) for r, c in (("p", "x"), ("q", "y"))]
            pairs = pairs.where("p IS NOT NULL AND q IS NOT NULL").join(named[0], "p").join(named[1], "q")
        done = ended if done is None else done.unionByName(ended)
    return done


def nearest_smaller(values: list[int], least: list[int]) -> tuple[list[int], list[int]]:
    """For each position the nearest one to the left with a smaller value (-1: none), and the least of `least` over the positions between."""
    place, between, stack = [], [], []
    for i, v in enumerate(values):
        m = NONE
        while stack and values[stack[-1]] >= v:
            j = stack.pop()
            m = min(m, between[j], least[j])
        place.append(stack[-1] if stack else -1)
        between.append(m)
        stack.append(i)
    return place, between


def block_nodes(block: int, first: int, lcp: np.ndarray, least: np.ndarray, minima: np.ndarray, block_least: np.ndarray) -> dict[str, list]:
    """Nodes of the Cartesian tree seen in one block, equal ones merged: rep (their first position), v, l, r, m, n (positions merged) and, where an end is in another block, its number.

    `minima` and `block_least` have the least LCP and the least id of every block.
    """
    v, ids = lcp.tolist(), least.tolist()
    left, left_m = nearest_smaller(v, ids)
    right, right_m = nearest_smaller(v[::-1], ids[::-1])
    right, right_m = [len(v) - 1 - p for p in right[::-1]], right_m[::-1]  # len(v): none
    out: dict[str, list] = {c: [] for c in ("rep", "v", "l", "r", "m", "n", "l_block", "r_block")}
    of, nodes = [], {}
    before, after = minima[:block][::-1], minima[block + 1 :]
    falling, falling_after = np.minimum.accumulate(before), np.minimum.accumulate(after)
    ids_before, ids_after = np.minimum.accumulate(block_least[:block][::-1]), np.minimum.accumulate(block_least[block + 1 :])
    for i, value in enumerate(v):
        found = nodes.get((left[i], value))
        if found is not None:
            out["n"][found] += 1
        else:
            found = nodes[left[i], value] = len(out["v"])
            m = min(ids[i], left_m[i], right_m[i])
            steps: list[int | None] = [None, None]
            if left[i] >= 0:
                m = min(m, ids[left[i]])
            elif value >= 0:
                k = int(np.searchsorted(-falling, -value, side="right"))
                steps[0], m = block - 1 - k, min(m, int(ids_before[k - 1])) if k else m
            if right[i] == len(v):
                k = int(np.searchsorted(-falling_after, -value, side="right"))
                m = min(m, int(ids_after[k - 1])) if k else m
                steps[1] = block + 1 + k if k < len(after) else None
            for c, x in zip(out, (first + i, value, left[i], right[i], m, 1, *steps), strict=True):
                out[c].append(x)
        of.append(out["rep"][found])
    out["l"] = [None if p < 0 else first + p for p in out["l"]]
    out["r"] = [None if p == len(v) else first + p for p in out["r"]]
    return out | {"of": of}


NODE = "rep long, v long, l long, r long, m long, n long, l_block long, r_block long"


def _sorted(table: pa.Table) -> dict[str, np.ndarray]:
    ordered = table.sort_by("at")
    return {c: ordered.column(c).to_numpy() for c in ordered.column_names}


def cartesian_tree(positions: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(rep and at of every position; merged nodes with rep, v, l, r, m and n) of (at, lcp, conv_id, block); l is null and v -1 at the first position, r is `count` past the last."""
    sums = positions.groupBy("block").agg(F.min("lcp").alias("lcp"), F.min("conv_id").alias("least")).orderBy("block").collect()
    minima, block_least = np.array([r["lcp"] for r in sums]), np.array([r["least"] for r in sums])

    def find(table: pa.Table) -> pa.Table:
        x = _sorted(table)
        found = block_nodes(int(x["block"][0]), int(x["at"][0]), x["lcp"], x["conv_id"], minima, block_least)
        of = found.pop("of")
        same = {a: k for k, a in enumerate(found["rep"])}
        rows = {"at": pa.array(x["at"]), "of": pa.array(of, pa.int64())}
        for c, values in found.items():
            rows[c] = pa.array([values[same[a]] if a in same else None for a in x["at"].tolist()], pa.int64())
        return pa.table(rows)

    found = written(positions.select("block", "at", "lcp", "conv_id").groupBy("block").applyInArrow(find, f"at long, of long, {NODE}"))
    asked = [found.where(f"{c} IS NOT NULL").select(F.col(c).alias("block"), F.lit(side).alias("side"), "v") for side, c in ((0, "l_block"), (1, "r_block"))]
    asked = asked[0].union(asked[1]).distinct()

    def answer(table: pa.Table, questions: pa.Table) -> pa.Table:
        rows = []
        x = _sorted(table)
        if questions.num_rows and len(x["at"]):
            lcp, ids = x["lcp"], x["conv_id"]
            down, up = np.minimum.accumulate(lcp[::-1]), np.minimum.accumulate(lcp)
            ids_down, ids_up = np.minimum.accumulate(ids[::-1]), np.minimum.accumulate(ids)
            for side, v in zip(questions.column("side").to_pylist(), questions.column("v").to_pylist(), strict=True):
                k = int(np.searchsorted(-(down, up)[side], -v, side="right"))  # the first below v
                if side == 0:
                    rows.append((int(x["block"][0]), 0, v, int(x["at"][len(lcp) - 1 - k]), int(ids_down[k])))
                else:
                    rows.append((int(x["block"][0]), 1, v, int(x["at"][k]), int(ids_up[k - 1]) if k else NONE))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(values, kind) for c, values, kind in zip(("a_block", "a_side", "a_v", "a_at", "a_m"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    answers = written(positions.select("block", "at", "lcp", "conv_id").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(answer, "a_block long, a_side int, a_v long, a_at long, a_m long"))
    nodes = found.where("rep IS NOT NULL").drop("at", "of")
    for side, c in ((0, "l"), (1, "r")):
        inside, outside = nodes.where(f"{c}_block IS NULL"), nodes.where(f"{c}_block IS NOT NULL")
        told = answers.where(f"a_side = {side}")
        outside = outside.join(told, (F.col(f"{c}_block") == F.col("a_block")) & (F.col("v") == F.col("a_v"))).withColumns({c: F.col("a_at"), "m": F.least("m", "a_m")})
        nodes = inside.unionByName(outside.select(inside.columns))
    return found.select("at", "of"), written(nodes.select("rep", "v", "l", F.coalesce("r", F.lit(count)).alias("r"), "m", "n"))


def members_digest(members: DataFrame) -> DataFrame:
    """at and ends_sha256 (of its conv_ids, ascending, joined by commas) of (at, conv_id, w); the ids of large groups are streamed in order through one hash."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, sha256()
        for batch in batches:
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"at": [now], "ends_sha256": [h.hexdigest()]})
                    now, h = at, sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
        if now is not None:
            yield pa.RecordBatch.from_pydict({"at": [now], "ends_sha256": [h.hexdigest()]})

    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    few = members.where(F.col("w") <= IDS).groupBy("at").agg(F.sha2(ids, 256).alias("ends_sha256"))
    many = members.where(F.col("w") > IDS)
    if many.isEmpty():
        return few
    chunks = placed(many.select("at", "conv_id"), "at", ["conv_id"]).groupBy("at", F.expr(f"{PLACE} div {IDS}").alias("chunk")).agg(ids.alias("ids"))
    return few.unionByName(chunks.repartition("at").sortWithinPartitions("at", "chunk").select("at", "ids").mapInArrow(stream, "at long, ends_sha256 string"))


def running(sequences: DataFrame, size: int) -> DataFrame:
    """Add `<c>_before` for each column of SUMS: its sum over the positions before; and a last row, past all, with the totals."""
    sums = sequences.groupBy("block").agg(*(F.sum(c).alias(c) for c in SUMS)).orderBy("block").collect()
    begin = {c: np.cumsum([0, *(r[c] for r in sums)]).tolist() for c in SUMS}

    def add(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("at")
        block = ordered.column("block")[0].as_py()
        for c in SUMS:
            x = ordered.column(c).to_numpy()
            ordered = ordered.append_column(f"{c}_before", pa.array(np.cumsum(x) - x + begin[c][block]))
        return ordered

    schema = ", ".join([f"{n} {t}" for n, t in sequences.dtypes] + [f"{c}_before bigint" for c in SUMS])
    found = sequences.groupBy("block").applyInArrow(add, schema)
    last = {"at": size, "lcp": -1} | {f"{c}_before": begin[c][-1] for c in SUMS}
    end = sequences.sparkSession.range(1).select(*(F.lit(last.get(n)).cast(t).alias(n) for n, t in [*sequences.dtypes, *((f"{c}_before", "bigint") for c in SUMS)]))
    return found.unionByName(end)


def expanded(intervals: DataFrame, about: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of (l, v, r, m, n), merged nodes and leaves: each with the depths above it that have one child.

    `about` has the LCP, the running sums and the node (`up`, its least id) at each position: the end
    of an interval with the deeper LCP names the interval's parent.
    """

    def side(name: str) -> DataFrame:
        return about.select(F.col("at").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in about.columns if c not in ("at", "of", "block")))

    x = intervals.join(side("l"), "l").join(side("r").drop("r_ends_sha256"), "r")
    x = x.withColumn("above", F.greatest("l_lcp", "r_lcp")).withColumn("depth", F.explode(F.sequence(F.col("above") + 1, F.col("v"))))
    before = turns.select(F.col("conv_id").alias("l_conv_id"), "depth", F.col("before"))
    x = x.join(before, ["l_conv_id", "depth"], "left").na.fill(0, ["before"])

    def between(c: str) -> Column:
        return F.col(f"r_{c}_before") - F.col(f"l_{c}_before")

    texts_once = between("new_chars") - F.col("l_new_chars") + F.col("l_chars") - F.col("before")
    children = F.when(F.col("depth") < F.col("v"), 1).when(F.col("n") > 0, F.col("n") + 1 - (F.col("l_length") == F.col("v")).cast("int")).otherwise(0)
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("above") + 1, F.col("m")).when(F.col("l_lcp") >= F.col("r_lcp"), F.col("l_up")).otherwise(F.col("r_up"))
    return x.select(
        F.col("m").alias("conv_id"),
        "depth",
        parent.alias("parent_conv_id"),
        between("w").alias("n_convs"),
        children.cast("long").alias("n_children"),
        between("leaf").alias("n_leaves"),
        (between("all_chars") - between("w") * F.col("before") - texts_once).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("l_length"), F.col("l_ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations, from the root (depth 0) down.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the code points of a node's last text) and
    ends_sha256 (of the ids of the members that end at the node). Turns are ordered by turn, null
    first, equal ones by their digest; repeated rows are turns of their own. A null role or text is
    empty; rows without conv_id belong to no conversation; without rows there is no node, not even a
    root. Other columns of `conversations` are not read.
    """
    turns, lengths = rebuilt(conversations, every, heads)
    top, dictionaries = named_blocks(turns, lengths.agg(F.max("length")).first()[0] or 0)
    empty = F.array().cast(top.schema["items"].dataType)
    tops = written(lengths.join(top, "conv_id", "left").withColumn("items", F.coalesce("items", empty)))
    distinct = tops.groupBy("items").agg(F.min(F.struct("conv_id", "length", "chars")).alias("one"), F.count(F.lit(1)).alias("w"))
    sequences = written(numbered(distinct, ["items"]).select(F.col(PLACE).alias("at"), "items", "one.*", "w"))
    size = sequences.count()
    span = max(POSITIONS, -(-size // MOST_BLOCKS))
    lcp = written(neighbours_lcp(sequences, dictionaries))
    ends = members_digest(tops.join(sequences.select("items", "at", "w"), "items").select("at", "conv_id", "w"))
    after = lcp.select((F.col("at") - 1).alias("at"), F.col("lcp").alias("next"))
    joined = sequences.drop("items").join(lcp, "at", "left").join(after, "at", "left").join(ends, "at").na.fill(-1, ["lcp", "next"])
    shared = turns.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("before").alias("shared"))
    joined = joined.join(shared, (F.col("conv_id") == F.col("_c")) & (F.greatest("lcp", F.lit(0)) + 1 == F.col("_d")), "left")
    columns = {"block": F.expr(f"at div {span}"), "all_chars": F.col("w") * F.col("chars"), "new_chars": F.col("chars") - F.coalesce("shared", F.lit(0)), "leaf": (F.col("next") < F.col("length")).cast("long")}
    positions = written(joined.withColumns(columns).select("block", "at", "lcp", "conv_id", "length", "chars", "ends_sha256", *SUMS))
    summed = written(running(positions, size))
    of, nodes = cartesian_tree(positions, size)
    inner = nodes.where("v >= 0").groupBy("l", "v").agg(F.first("r").alias("r"), F.min("m").alias("m"), F.sum("n").alias("n"))
    leaves = positions.where("leaf = 1").select(F.col("at").alias("l"), F.col("length").alias("v"), (F.col("at") + 1).alias("r"), F.col("conv_id").alias("m"), F.lit(0).cast("long").alias("n"))
    about = written(summed.join(of, "at", "left").join(nodes.select(F.col("rep").alias("of"), F.col("m").alias("up")), "of", "left"))
    return expanded(inner.unionByName(leaves), about, turns)
