"""Removal of long repeated byte strings by distributed prefix doubling.

Ranking every byte position would move many times the corpus in each round, so positions are first
thinned by content. In every stretch of positions (160 for 400 bytes) the one whose next `GRAM` bytes have the
least hash is an anchor. What decides an anchor lies around it, so equal strings of `length` bytes
have the same anchors from their first stretch to their last, whatever surrounds them. Between two
anchors lies a phrase.

Prefix doubling runs on the anchors. Rank 0 names the phrase that begins at an anchor. In round j
each anchor's rank is paired with that of the anchor 2^j further on; Spark counts the pairs, sorts
those that occur again and numbers them: the rank of 2^(j+1) phrases. An anchor whose pair is unique
leaves; the others go on until the offset is past `length` bytes. Two overlapping ranks then tell
whether any q phrases occur again: those of the first and of the last 2^j.

For the windows (`length` bytes) that begin between two anchors this settles most at once: where the
phrases that hold all of them occur again, so do they. Inside a run of one phrase they occur again a
phrase further on, which needs no ranks; the first ones of a run stand for the others. What remains are windows at the ends of
repeats. One is compared only with windows that have the same phrases between their first and last
stretch, by 64-bit prints of the whole window, and only one occurrence of settled ones takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, mix, text_key, written
from waymark.llm.groups import PLACE, numbered

#: Bytes that are hashed at each position.
GRAM = 16
#: Bytes of texts that are hashed together, and windows that are compared together; those of more frequent phrases are dealt by their prints.
CHUNK, TOGETHER = 1 << 20, 1 << 17
#: Odd multipliers for phrases and windows, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2^64; the longest made so far is kept."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        out[0] = 1
        known[base] = np.cumprod(out, dtype=np.uint64)
    return known[base][:n]


def hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position of `data`, zeros after its end."""
    n = len(data)
    padded = data + bytes(GRAM + 16)
    eight = np.empty(n + 16, dtype=np.uint64)
    for r in range(8):
        part = eight[r::8]
        part[:] = np.frombuffer(padded, dtype="<u8", offset=r, count=len(part))
    return mix(eight[:n] * np.uint64(BASES[1]) + eight[8 : n + 8])


def reach_of(length: int) -> int:
    """Positions of a stretch: as many as leave the first and the last stretch of `length` bytes well apart."""
    reach = min((length - GRAM) * 5 // 12, (length - 1) // 2 - GRAM + 1)
    if reach < 2:
        raise ValueError(f"strings of {length} bytes are too short: at least {2 * (GRAM + 1) + 1}")
    return reach


class Phrases:
    """Anchors of one or more texts laid end to end; `begin` has where each text begins, and the end."""

    def __init__(self, texts: list[bytes], length: int):
        data = b"".join(texts)
        self.begin, self.length, self.reach = np.cumsum([0, *map(len, texts)]), length, reach_of(length)
        self.hash = hashes(data)
        n, place = len(data), np.uint64(0xFFFFFFFF)  # a text has less than 2^32 bytes; of equal halves of a hash the leftmost counts
        least = (self.hash & ~place) | np.arange(n, dtype=np.uint64)
        step = 1
        while 2 * step <= self.reach:  # least over 2, 4, ... positions
            least[:-step] = np.minimum(least[:-step], least[step:]) if n > step else least[:-step]
            step *= 2
        if n > (rest := self.reach - step) > 0:
            least[:-rest] = np.minimum(least[:-rest], least[rest:])
        self.first = (least & place).astype(np.int64)  # the anchor of the stretch that begins here
        whole = np.zeros(n, dtype=bool)
        for begin, end in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            whole[begin : max(begin, end - self.reach - GRAM + 2)] = True
        at = self.first[whole]
        self.at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
        self.text = np.searchsorted(self.begin, self.at, side="right") - 1

    def _sums(self, k: int) -> np.ndarray:
        n = len(self.hash)
        return np.concatenate(([np.uint64(0)], np.cumsum(self.hash * powers(BASES[k], n), dtype=np.uint64)))

    def names(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchors that have a next one in their text, names of the phrases from there through the next one's bytes) by the k-th hash."""
        here = np.flatnonzero(self.text[1:] == self.text[:-1])
        sums, n = self._sums(k), len(self.hash)
        return here, mix((sums[self.at[here + 1] + 1] - sums[self.at[here]]) * powers(INVERSES[k], n)[self.at[here]])

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the one up to whose bytes the windows reach that begin before the next anchor, and whether there is one."""
        n = len(self.at)
        if not n:
            return np.empty(0, np.int64), np.empty(0, bool)
        last = np.append(np.flatnonzero(self.text[1:] != self.text[:-1]), n - 1)[self.text_number()]
        c = np.arange(n)
        d = np.searchsorted(self.at, self.at[np.minimum(c + 1, n - 1)] - 1 + self.length - GRAM)
        return np.minimum(d, n - 1), (c < last) & (d <= last)

    def text_number(self) -> np.ndarray:
        """The texts that have anchors, numbered without gaps."""
        return np.cumsum(np.concatenate(([False], self.text[1:] != self.text[:-1])))[: len(self.at)]

    def runs(self, here: np.ndarray, names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whether the windows from each anchor on lie in a run of one phrase that goes on before or after them, and whether the run begins there.

        Such windows occur again a phrase further on or back. Those from the run's first anchor stand
        for all others in the search for further places.
        """
        n = len(self.at)
        phrase = np.full((len(names), n), 0, dtype=np.uint64)
        known = np.zeros(n, dtype=bool)
        known[here] = True
        for k, name in enumerate(names):
            phrase[k, here] = name
        same = (phrase[:, 1:] == phrase[:, :-1]).all(axis=0) & known[1:] & known[:-1]
        begins = np.concatenate(([True], ~same))[:n]
        number = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        low, high = first[number], np.append(first[1:], n)[number] - 1
        c = np.arange(n)
        d, inside = self.around()
        return inside & known & (high >= d - 1) & ((high >= d) | (low < c)), low == c

    def levels(self, left_out: np.ndarray) -> np.ndarray:
        """How many ranks (of 1, 2, 4, ... phrases) each anchor may be asked for: as many as an anchor before it needs whose windows reach it; those of anchors left out need none."""
        n = len(self.at)
        reached = np.minimum(np.searchsorted(self.at, self.at + self.length + self.reach), n)
        own = np.where(left_out, 0, np.log2(np.maximum(reached - np.arange(n), 1)).astype(np.int32) + 1)
        found = np.zeros(n, dtype=np.int32)
        for level in range(1, int(own.max(initial=0)) + 1):
            edges = np.zeros(n + 1, dtype=np.int64)
            asks = np.flatnonzero(own >= level)
            np.add.at(edges, asks, 1)
            np.add.at(edges, reached[asks], -1)
            found[np.cumsum(edges[:-1]) > 0] = level
        return found

    def prints(self) -> np.ndarray:
        """64-bit print of the window that begins at each position; one that reaches into another text has no meaning."""
        sums, n, inside = self._sums(0), len(self.hash), self.length - GRAM + 1
        if n < inside:
            return np.empty(0, np.uint64)
        return mix((sums[inside:] - sums[:-inside]) * powers(INVERSES[0], n - inside + 1))


def together(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of a batch with about CHUNK bytes; a longer text is alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        data = text.as_buffer()
        if held and size + data.size > CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(data.to_pybytes())
        size += data.size
    if held:
        yield first, held


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """Two kinds of rows over (tid, text): tid, i (number of an anchor in its text), name and check (two hashes of its phrase), levels (ranks that may be asked of it); and, levels 0, stretches of windows (first in i, n in name) inside a run of one phrase."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, held in together(batch, "text"):
                p = Phrases(held, length)
                (here, name), (_, check) = p.names(0), p.names(1)
                inside, begins = p.runs(here, [name, check])
                levels = p.levels(inside & ~begins)[here]
                begin = np.searchsorted(p.text, np.arange(len(held)))
                asked = levels > 0
                c = np.flatnonzero(inside)
                new = np.concatenate(([True], np.diff(c) != 1))[: len(c)]
                first, last = c[new], np.append(c[np.flatnonzero(new)[1:] - 1], c[-1:])
                owner = np.concatenate((p.text[here][asked], p.text[first]))
                at = np.concatenate(((here - begin[p.text[here]])[asked], p.at[first] - p.begin[p.text[first]]))
                size = (p.at[last + 1] - p.at[first]).astype(np.int64)
                zero = np.zeros(len(first), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(owner + row)), pa.array(at.astype(np.int32)), pa.array(np.concatenate((name[asked].view(np.int64), size))), pa.array(np.concatenate((check[asked].view(np.int64), zero))), pa.array(np.concatenate((levels[asked], zero)).astype(np.int32))], names=["tid", "i", "name", "check", "levels"])

    return texts.mapInArrow(find, "tid long, i int, name long, check long, levels int")


def reranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """tid, i, rank, levels of the rows whose `pair` occurs again: its number among all such pairs in their order."""
    again = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    ranks = written(numbered(again, pair).withColumnRenamed(PLACE, "_rank"))
    return written(rows.join(ranks, pair).select("tid", "i", F.col("_rank").alias("rank"), "levels"))


def doubled(texts: DataFrame, length: int) -> tuple[list[DataFrame], DataFrame]:
    """(ranks of 1, 2, 4, ... phrases: tid, i and rank of each anchor where these phrases occur again somewhere; tid, first and n of windows inside runs of a phrase)."""
    start = written(anchors(texts, length))
    runs = written(start.where("levels = 0").select("tid", F.col("i").alias("first"), F.col("name").cast("int").alias("n")))
    found = [reranked(start.where("levels > 0"), ["name", "check"])]
    discard(start)
    while True:
        offset = 1 << (len(found) - 1)
        going = found[-1].where(F.col("levels") > len(found))
        if going.isEmpty():
            return found, runs
        ahead = going.select("tid", (F.col("i") - offset).alias("i"), F.col("rank").alias("then"))
        pairs = written(going.join(ahead, ["tid", "i"]))
        found.append(reranked(pairs, ["rank", "then"]))
        discard(pairs)


def stretches(texts: DataFrame, length: int) -> DataFrame:
    """Windows that may occur again, in stretches between the same anchors, over (tid, text, ranks).

    tid, first, n, prints (8 bytes a window); m1, m2, mq: the phrases inside each window, as two ranks
    and their number; e1, e2, eq: the phrases around all of them, eq 0 where these occur nowhere else;
    off: bytes from there.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("ranks")
            each = {c: ranks.flatten().field(c).to_numpy() for c in ("level", "i", "rank")}
            ends = np.cumsum(ranks.value_lengths().to_numpy())
            for row, held in together(batch, "text"):
                low, high = (ends[row - 1] if row else 0), ends[row + len(held) - 1]
                mine = {c: x[low:high] for c, x in each.items()}
                of = np.repeat(np.arange(len(held)), np.diff(np.concatenate(([low], ends[row : row + len(held)]))))
                yield _stretches(Phrases(held, length), of, mine, batch.column("tid").slice(row, len(held)))

    return texts.mapInArrow(find, "tid long, first int, n int, m1 long, m2 long, mq int, e1 long, e2 long, eq int, off int, prints binary")


def _stretches(p: Phrases, of: np.ndarray, ranks: dict[str, np.ndarray], tid: pa.Array) -> pa.RecordBatch:
    n, length = len(p.hash), p.length
    begin = np.searchsorted(p.text, np.arange(len(p.begin)))  # first anchor of each text
    table = np.full((int(ranks["level"].max(initial=0)) + 1, len(p.at) + 1), -1, dtype=np.int64)
    table[ranks["level"], begin[of] + ranks["i"]] = ranks["rank"]

    def repeated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two ranks and number of the phrases between anchors a and b; 0 where they are unique."""
        q = b - a
        level = np.log2(np.maximum(q, 1)).astype(np.int64)
        inside = (q > 0) & (level < len(table))
        level = np.where(inside, level, 0)
        r1, r2 = table[level, np.where(inside, a, -1)], table[level, np.where(inside, b - (1 << level), -1)]
        return r1, r2, np.where((r1 >= 0) & (r2 >= 0) & inside, q, 0)

    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(p.begin[:-1], p.begin[1:], strict=True)] or [np.empty(0, np.int64)])
    number = np.zeros(n, dtype=np.int32)
    number[p.at] = 1
    number = np.cumsum(number, dtype=np.int32) - 1  # the last anchor up to each position
    f, g, c = number[p.first[starts]], number[p.first[starts + length - p.reach - GRAM + 1]], number[starts]
    new = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else np.empty(0, np.int64)
    first, size = starts[new], np.diff(np.append(new, len(starts)))
    f, g, c, text = f[new], g[new], c[new], np.searchsorted(p.begin, first, side="right") - 1
    m1, m2, mq = repeated(f, g)
    live = np.flatnonzero(mq)
    first, size, c, text, m1, m2, mq = (x[live] for x in (first, size, c, text, m1, m2, mq))
    following = np.minimum(c + 1, len(p.at) - 1)
    d = np.searchsorted(p.at, p.at[following] - 1 + length - GRAM) if len(p.at) else c
    inside = (c >= begin[text]) & (c + 1 < begin[text + 1]) & (d < begin[text + 1])
    e1, e2, eq = repeated(np.where(inside, c, 0), np.where(inside, d, 0))
    off = first - p.at[np.maximum(c, 0)] if len(p.at) else first
    values = (first - p.begin[text], size, m1, m2, mq, e1, e2, eq, np.where(eq > 0, off, 0))
    kinds = (np.int32, np.int32, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int32)
    ends = np.cumsum(size)
    places = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    blob = p.prints()[places] if len(places) else np.empty(0, np.uint64)
    offsets = (8 * np.concatenate(([0], ends))).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
    return pa.RecordBatch.from_arrays([tid.take(pa.array(text)), *(pa.array(v.astype(k)) for v, k in zip(values, kinds, strict=True)), packed], names=["tid", "first", "n", "m1", "m2", "mq", "e1", "e2", "eq", "off", "prints"])


def dealt(rows: DataFrame, bins: int) -> DataFrame:
    """bin, tags (a print with its phrases), tids and places of the windows of (tid, first, m1, m2, mq, prints, hot): by phrases, or by tag where these are hot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                x = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("tid", "first", "m1", "m2", "mq", "hot")}
                blobs = part.column("prints").to_pylist()
                sizes = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
                phrases = mix(mix(mix(x["m1"].view(np.uint64)) + x["m2"].view(np.uint64)) + x["mq"].astype(np.uint64))
                row = np.repeat(np.arange(len(sizes)), sizes)
                tags = mix(np.frombuffer(b"".join(blobs), dtype=np.uint64) ^ phrases[row])
                place = x["first"][row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                to = (np.where(x["hot"][row], tags, phrases[row]) >> np.uint64(20)) % np.uint64(bins)
                order = np.argsort(to, kind="stable")
                to, tags, tids, place = to[order], tags[order], x["tid"][row][order], place[order].astype(np.int32)
                cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, np.int64)
                ends = np.append(cuts[1:], len(to))
                blob = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int32)), blob(tags), blob(tids), blob(place)], names=["bin", "tags", "tids", "places"])

    return rows.mapInArrow(deal, "bin int, tags binary, tids binary, places binary")


def equal_windows(live: DataFrame, windows: int) -> DataFrame:
    """tid, first and n of the windows among `live` that have an equal one; `windows` is their number, by which they are dealt to bins of about TOGETHER."""

    def compare(table: pa.Table) -> pa.Table:
        tags, tids, places = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("tags", np.uint64), ("tids", np.int64), ("places", np.int32)))
        order = np.argsort(tags, kind="stable")
        same = tags[order][1:] == tags[order][:-1]
        twice = np.zeros(len(tags), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        tids, places = tids[twice], places[twice]
        order = np.lexsort((places, tids))
        tids, places = tids[order], places[order]
        begin = np.flatnonzero(np.concatenate(([True], (tids[1:] != tids[:-1]) | (np.diff(places) != 1)))) if len(tids) else np.empty(0, np.int64)
        return pa.table({"tid": pa.array(tids[begin]), "first": pa.array(places[begin]), "n": pa.array(np.diff(np.append(begin, len(tids))).astype(np.int32))})

    return dealt(live, -(-windows // TOGETHER) or 1).groupBy("bin").applyInArrow(compare, "tid long, first int, n int")


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """tid and stretches (first, n) of the windows that occur more than once among the distinct texts (tid, text)."""
    around, inside = ["e1", "e2", "eq", "off"], ["m1", "m2", "mq"]
    rounds, runs = doubled(texts, length)
    ranked = reduce(DataFrame.unionByName, [found.select("tid", F.lit(level).alias("level"), "i", "rank") for level, found in enumerate(rounds)])
    ranks = ranked.groupBy("tid").agg(F.collect_list(F.struct("level", "i", "rank")).alias("ranks"))
    rows = written(stretches(texts.join(ranks, "tid").select("tid", "text", "ranks"), length))
    for found in rounds:
        discard(found)
    known = rows.where("eq > 0")
    spot = F.struct("tid", "first")
    again = written(known.groupBy(*around).agg(F.count(F.lit(1)).alias("times"), F.min(spot).alias("least")))
    told = known.join(again, around).select("tid", "first", "n", *inside, "prints", (F.col("times") > 1).alias("settled"), (spot == F.col("least")).alias("searched"))
    fresh = rows.where("eq = 0").select("tid", "first", "n", *inside, "prints", F.lit(False).alias("settled"), F.lit(True).alias("searched"))
    told = written(told.unionByName(fresh).withColumn("prints", F.when(F.col("searched"), F.col("prints"))))
    discard(rows)
    discard(again)
    searched = told.where("searched")
    open_ = searched.groupBy(*inside).agg(F.count(F.lit(1)).alias("rows"), F.min("settled").alias("closed"), F.sum("n").alias("windows")).where("rows > 1 AND NOT closed")
    open_ = written(open_.select(*inside, "windows", (F.col("windows") > TOGETHER // 8).alias("hot")))
    windows = open_.agg(F.sum("windows")).first()[0] or 0
    live = searched.join(open_.drop("windows"), inside).select("tid", "first", *inside, "prints", "hot")
    found = told.where("settled").select("tid", "first", "n").unionByName(runs).unionByName(equal_windows(live, windows))
    stretches_ = written(found.groupBy("tid").agg(F.collect_list(F.struct("first", "n")).alias("stretches")))
    for done in (told, open_, runs):
        discard(done)
    return stretches_


def repeats(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """key, text, copies and stretches (null: none) of each distinct text with repeated strings of `length` bytes; a text with copies is one whole repeat."""
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    texts = written(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).withColumn("tid", F.monotonically_increasing_id()))
    found = repeated_windows(texts.select("tid", "text"), length)
    return texts.join(found, "tid", "left").where("copies > 1 OR stretches IS NOT NULL")


def removed_bytes(n_bytes: int, copies: int, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte of a text goes, with windows in stretches of n from `first` on."""
    if copies > 1:
        return np.ones(n_bytes, dtype=bool)
    edges = np.bincount(first, minlength=n_bytes + 1) - np.bincount(first + n - 1 + length, minlength=n_bytes + 1)
    return np.cumsum(edges[:-1]) > 0


def cut_repeats(docs: DataFrame, *, length: int = 400, text_col: str = "text") -> DataFrame:
    """key (md5 of the text), n_removed, n_spans (maximal removed runs) and kept (bytes, which may split a character) of each distinct text that loses bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column("stretches")
            first, n = (lists.flatten().field(c).to_numpy() for c in ("first", "n"))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            for text, copies, low, high in zip(batch.column("text"), batch.column("copies").to_pylist(), np.append(0, ends), ends, strict=False):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                gone = removed_bytes(len(data), copies, first[low:high], n[low:high], length)
                rows.append((int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone)), data[~gone].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["key", "n_removed", "n_spans", "kept"])

    return repeats(docs, text_col, length).mapInArrow(cut, "key binary, n_removed long, n_spans long, kept binary")


def doubling_digest(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Each byte goes that is covered by a string of `length` bytes that also starts elsewhere, in the
    same text or another; strings do not cross texts and are judged on the input, so all occurrences
    go, copies and repeated rows included. A null text is empty; an empty one or one shorter than
    `length` loses nothing. Null ids are kept as rows. Other columns of `docs` are not read.
    """
    changed = cut_repeats(docs, length=length, text_col=text_col).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    joined = rows.join(changed, "key", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
