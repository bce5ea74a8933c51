"""Removal of long repeated passages by recompression.

A text's words are named by 64-bit hashes. Each round renames the symbols of all texts: a run of
equal symbols, then each pair whose left symbol is in the left half of the alphabet and whose right
symbol is in the right half, becomes one symbol, named by a hash of what it stands for. Names depend
on content alone, so all tasks agree on them without exchanging a dictionary, and occurrences of the
same words get the same symbols but for a few at their ends. For every symbol it is known which
words decide it (its reach).

High symbols reveal long repeats: a symbol of a late round stands for many words, so where one occurs
again, all windows (a fixed number of consecutive words) inside it are settled at once, and so are
those inside a long run of a symbol of any round, which repeats itself. The least occurrence stays in
the search for the windows' other places; the rest need not be looked at again.

For the ends of repeats and for short ones, a window is filed under one symbol whose reach lies
inside it: of those of the highest early round, the one with the least name. Equal windows are
therefore filed under equal symbols, at the same distance. Spark counts the symbols that windows are
filed under; only where a symbol occurs again are the fingerprints of its windows made and compared,
which verifies the repeat on every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, hash_words, mix, text_key, unused, words_of, written

#: Rounds after which windows are filed, and rounds whose symbols are looked for as a whole; a round makes about 4/3 words of one.
ROUNDS, HIGH_ROUNDS = 5, (14, 18, 22, 26)
#: Occurrences of a symbol whose windows one task compares; windows of more frequent symbols are counted by fingerprint.
TOGETHER = 2000
#: An odd multiplier for window fingerprints, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FAR = 1 << 40


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2^64; the longest made so far is kept."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, 1 << 15), base, dtype=np.uint64)
        out[0] = 1
        known[base] = np.cumprod(out, dtype=np.uint64)
    return known[base][:n]


class Symbols:
    """Symbols of concatenated texts: name, first word, and reach [low, high) in words; `text` numbers the texts."""

    def __init__(self, names: np.ndarray, text: np.ndarray):
        self.words, self.name, self.text = names, names, text
        self.at = np.arange(len(names))
        self.low, self.high = self.at.copy(), self.at + 1

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        """low of the left neighbour and high of the right one; beyond everything at the ends of a text."""
        left, right = np.full(len(self.name), -FAR), np.full(len(self.name), FAR)
        same = self.text[1:] == self.text[:-1]
        left[1:][same] = self.low[:-1][same]
        right[:-1][same] = self.high[1:][same]
        return left, right

    def _keep(self, starts: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The groups of symbols that begin at `starts` become one symbol each."""
        self.name, self.text, self.at = names, self.text[starts], self.at[starts]
        self.low, self.high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each maximal run of one symbol becomes a symbol; what stands beside it decides where it ends.

        A neighbour whose nearest word is not the one a repetition would have is another symbol, so
        that word decides; only where it is the same does the neighbour's whole reach count.

        A run repeats itself: it is the same with its first unit left out and with its last one left
        out. Returns (name, first window, windows) of both for runs in which that is a window or more.
        """
        none = np.empty(0, np.int64)
        if not len(self.name):
            return none.view(np.uint64), none, none
        new = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(self.name)))
        left, right = self._sides()
        end = np.append(self.at[1:], len(self.words))
        before, after = self.words[np.maximum(self.at - 1, 0)], self.words[np.minimum(end, len(self.words) - 1)]
        same = np.concatenate(([False], self.text[1:] == self.text[:-1], [False]))
        left = np.where((before != self.words[end - 1]) & same[:-1], self.at - 1, left)
        right = np.where((after != self.words[self.at]) & same[1:], end + 1, right)
        names = self.name[starts]
        names = np.where(sizes > 1, mix(names ^ mix(sizes.astype(np.uint64))), names)
        words = np.diff(np.append(self.at[starts], len(self.words)))
        unit = words // sizes
        n = words - unit - window + 1
        long = np.flatnonzero((sizes > 1) & (n > 0))
        both = np.tile(long, 2)
        found = mix(names[both] + np.uint64(2)), np.concatenate((self.at[starts][long], self.at[starts][long] + unit[long])), n[both]
        self._keep(starts, names, np.minimum(self.low, left), np.maximum(self.high, right))
        return found

    def pairs(self, number: int) -> None:
        """Left and right symbols that stand together become one; halves are drawn anew each round."""
        if not len(self.name):
            return
        is_right = (mix(self.name + np.uint64(number)) & np.uint64(1)).astype(bool)
        joined = ~is_right[:-1] & is_right[1:] & (self.text[1:] == self.text[:-1])
        second = np.concatenate(([False], joined))
        first = np.concatenate((joined, [False]))
        left, right = self._sides()
        # a symbol of the left half that stays alone is decided by what follows it, one of the right half by what precedes it
        low = np.where(is_right & ~second, left, self.low)
        high = np.where(~is_right & ~first, right, self.high)
        starts = np.flatnonzero(~second)
        names = self.name[starts]
        follower = self.name[np.minimum(starts + 1, len(self.name) - 1)]
        names = np.where(first[starts], mix(mix(names) + follower), names)
        self._keep(starts, names, low, high)


def high_symbols(symbols: Symbols, window: int, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows) of each symbol of a late round that stands for a window or more, once; `done` rounds are made."""
    found, known = [], np.zeros(len(symbols.words), dtype=np.uint64)
    for number in range(done, HIGH_ROUNDS[-1]):
        found.append(symbols.runs(window))
        symbols.pairs(number)
        if number + 1 in HIGH_ROUNDS:
            n = np.diff(np.append(symbols.at, len(symbols.words))) - window + 1
            long = np.flatnonzero((n > 0) & (known[symbols.at] != symbols.name))
            known[symbols.at[long]] = symbols.name[long]
            found.append((mix(symbols.name[long] + np.uint64(1)), symbols.at[long], n[long]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def filed_windows(hashes: np.ndarray, text: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbol, first window, windows) of each stretch of windows filed under one symbol, by positions in `hashes`, then of each run and high symbol; and the number of the former.

    A window without a symbol inside its reach (a long run of a word, say) is filed under a name of
    the set of its words.
    """
    starts = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :]) if len(text) >= window else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts, 0
    symbols, layers, selves = Symbols(hashes, text), [], []
    for number in range(rounds):
        selves.append(symbols.runs(window))
        symbols.pairs(number)
        inside = symbols.high - symbols.low <= window
        layers.append((symbols.name[inside], symbols.at[inside], symbols.low[inside], symbols.high[inside]))
    best_name, best_at = np.zeros(len(hashes), dtype=np.uint64), np.full(len(hashes), -1, dtype=np.int64)
    for name, at, low, high in reversed(layers):  # windows [high - window, low] hold the reach
        found = _least(name, at, high - window, low, len(hashes))
        named = np.zeros(len(hashes), dtype=np.uint64)
        named[at] = name
        take = (best_at < 0) & (found >= 0)
        best_at[take], best_name[take] = found[take], named[found[take]]
    name, at = best_name[starts], best_at[starts]
    alone = at < 0
    if alone.any():
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)))
        at[alone] = starts[alone]
        name[alone] = mix(sums[starts[alone] + window] - sums[starts[alone]])
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (name[1:] != name[:-1])))
    first = np.flatnonzero(new)
    filed = name[first], starts[first], np.diff(np.append(first, len(starts)))
    return *(np.concatenate(x) for x in zip(filed, *selves, high_symbols(symbols, window, rounds), strict=True)), len(first)


def _least(name: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """For each window the place of the symbol with the least name among those whose stretch [first, last] holds the window; -1 without.

    Of equal names the leftmost counts: the low bits of a name give way to the place. Stretches are
    no longer than a window, so minima over powers of two serve all of them.
    """
    bits = np.uint64(max(24, n.bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    key = (name & ~place) | at.astype(np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    first, last = np.maximum(first, 0), np.minimum(last, n - 1)
    power = np.log2(np.maximum(last - first + 1, 1)).astype(np.int64)
    top = int(power.max(initial=0)) + 1
    levels = np.full((top, n), none, dtype=np.uint64)
    np.minimum.at(levels, (power, first), key)
    np.minimum.at(levels, (power, last - (1 << power) + 1), key)
    for k in range(top - 1, 0, -1):  # a stretch of 2^k windows is two of 2^(k-1)
        half = 1 << (k - 1)
        np.minimum(levels[k - 1], levels[k], out=levels[k - 1])
        np.minimum(levels[k - 1, half:], levels[k, :-half], out=levels[k - 1, half:])
    least = levels[0]
    return np.where(least == none, np.int64(-1), (least & place).astype(np.int64))


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """64-bit fingerprint of the window that begins at each position."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)))
    return mix((sums[window:] - sums[:-window]) * powers(INVERSE, len(hashes) - window + 1))


def _chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) of stretches of a batch with about `most` bytes of text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        held.append(words_of(text.as_py()))
        size += len(held[-1]) * 8
        if size > most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def filings(texts: DataFrame, window: int, rounds: int) -> DataFrame:
    """symbol, check, key, first (window), n (windows) and whole over a table of key and text.

    whole: the symbol stands for all words of the windows, of which `check` is a second hash; else 0.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _chunks(batch, 1):
                sizes = np.array([len(w) for w in words])
                begin = np.cumsum(sizes) - sizes
                text = np.repeat(np.arange(len(words)), sizes)
                hashes = hash_words([w for ws in words for w in ws])
                symbol, first, n, low = filed_windows(hashes, text, window, rounds)
                owner = text[first] if len(first) else first
                sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)))
                whole = np.arange(len(first)) >= low
                check = np.where(whole, (sums[first + n + window - 1] - sums[first]) * powers(INVERSE, len(hashes) + 1)[first], np.uint64(0)) if len(first) else symbol
                columns = [symbol.view(np.int64), check.view(np.int64), None, (first - begin[owner]).astype(np.int32) if len(first) else first.astype(np.int32), n.astype(np.int32), whole]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + row)) if c is None else pa.array(c) for c in columns], names=["symbol", "check", "key", "first", "n", "whole"])

    return texts.mapInArrow(file, "symbol long, check long, key binary, first int, n int, whole boolean")


def _apart(first: np.ndarray, n: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, n) of the parts of stretches whose windows `keep` holds."""
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    stays = np.flatnonzero(keep[at])
    if not len(stays):
        return stays, stays, stays
    row, at = row[stays], at[stays]
    begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (np.diff(at) != 1))))
    return row[begin], at[begin], np.diff(np.append(begin, len(row)))


def printed(candidates: DataFrame, window: int) -> DataFrame:
    """symbol, times, key, first, n and prints (8 bytes a window) over a table of key, text and stretches of windows.

    Windows settled by whole symbols come first, with times 0 and no prints; they are left out of the
    others but where the symbol's occurrence is its least.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                prints = [fingerprints(hash_words(words_of(text.as_py())), window) for text in part.column(1)]
                begin = np.cumsum([0, *map(len, prints)])
                stretches = part.column(2)
                owner = np.repeat(np.arange(len(prints)), stretches.value_lengths().to_numpy())
                symbol, times, first, n, whole, least = (stretches.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("symbol", "times", "first", "n", "whole", "least"))
                at, n = first + begin[owner], n.astype(np.int64)
                settled, live = np.zeros(begin[-1], dtype=bool), np.ones(begin[-1], dtype=bool)
                for a, k, is_least in zip(at[whole].tolist(), n[whole].tolist(), least[whole].tolist(), strict=True):
                    settled[a : a + k] = True
                    if not is_least:
                        live[a : a + k] = False
                text, at_settled, n_settled = _apart(begin[:-1], np.diff(begin), settled)
                low = np.flatnonzero(~whole)
                row, at_live, n_live = _apart(at[low], n[low], live)
                row = low[row]
                places = np.repeat(at_live - (np.cumsum(n_live) - n_live), n_live) + np.arange(n_live.sum())
                blob = np.concatenate([np.empty(0, np.uint64), *prints])[places]
                offsets = (8 * np.concatenate((np.zeros(len(text) + 1, np.int64), np.cumsum(n_live)))).astype(np.int32)
                of = np.concatenate((text, owner[row]))
                at, n = np.concatenate((at_settled, at_live)), np.concatenate((n_settled, n_live))
                zero = np.zeros(len(text), np.int64)
                packed = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((zero, symbol[row]))), pa.array(np.concatenate((zero, times[row]))), part.column(0).take(pa.array(of)), pa.array((at - begin[of]).astype(np.int32)), pa.array(n.astype(np.int32)), packed], names=["symbol", "times", "key", "first", "n", "prints"])

    return candidates.mapInArrow(make, "symbol long, times long, key binary, first int, n int, prints binary")


def repeated_in_task(rows: DataFrame) -> DataFrame:
    """key and start of each stretch of windows that occur twice under their symbol, and its length; all rows of a symbol are in one task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        blobs = whole.column("prints").to_pylist()
        prints = np.frombuffer(b"".join(blobs), dtype=np.uint64)
        sizes = np.array([len(b) // 8 for b in blobs])
        row = np.repeat(np.arange(len(sizes)), sizes)
        tagged = mix(prints ^ mix(whole.column("symbol").to_numpy().view(np.uint64))[row])
        order = np.argsort(tagged, kind="stable")
        ordered = tagged[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(tagged), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        if not len(at):
            return
        start = whole.column("first").to_numpy()[row[at]] + at - (np.cumsum(sizes) - sizes)[row[at]]
        new = np.concatenate(([True], (row[at][1:] != row[at][:-1]) | (np.diff(at) != 1)))
        begin = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([whole.column("key").combine_chunks().take(pa.array(row[at][begin])), pa.array(start[begin].astype(np.int32)), pa.array(np.diff(np.append(begin, len(at))).astype(np.int32))], names=["key", "first", "n"])

    return rows.mapInArrow(compare, "key binary, first int, n int")


def repeated_by_count(rows: DataFrame) -> DataFrame:
    """key and the array of its stretches of windows that occur twice, for symbols of any frequency.

    Stretches with the same windows, as copies of a passage have, are counted once with their number;
    the windows of distinct stretches are counted by fingerprint, and the answer goes back by stretch.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                blobs = part.column("prints").to_pylist()
                sizes = np.array([len(b) // 8 for b in blobs])
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("symbol").take(index), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int64)), part.column("mark").take(index), pa.array(place.astype(np.int32)), part.column("copies").take(index)], names=["symbol", "print", "mark", "place", "copies"])

    marked = rows.select("symbol", "key", "first", "prints", F.unhex(F.md5("prints")).alias("mark"))
    distinct = marked.groupBy("symbol", "mark").agg(F.first("prints").alias("prints"), F.count(F.lit(1)).alias("copies"))
    windows = distinct.mapInArrow(spread, "symbol long, print long, mark binary, place int, copies long")
    twice = windows.groupBy("symbol", "print").agg(F.sum("copies").alias("times")).where("times > 1").drop("times")
    places = windows.join(twice, ["symbol", "print"]).groupBy("symbol", "mark").agg(F.collect_list("place").alias("places"))
    found = marked.drop("prints").join(places, ["symbol", "mark"])
    return found.select("key", F.transform("places", lambda p: F.struct((F.col("first") + p).alias("first"), F.lit(1).alias("n"))).alias("stretches"))


def repeated_windows(texts: DataFrame, window: int, rounds: int = ROUNDS) -> DataFrame:
    """key and an array of stretches (first, n) of windows that occur more than once among distinct texts.

    An occurrence's spot orders it: a hash of its text, then its place. A window left out has an
    equal one at a smaller spot (that of the least occurrence of the symbol around it), so of all
    equal windows some stay in the search.
    """
    filed = written(filings(texts, window, rounds))
    spot = F.shiftleft(F.shiftrightunsigned(F.xxhash64("key"), 33), 31).bitwiseOR(F.col("first").cast("long"))
    again = written(filed.groupBy("symbol", "check").agg(F.count(F.lit(1)).alias("times"), F.min(F.when(F.col("whole"), spot)).alias("least")).where("times > 1"))
    stretch = F.struct("symbol", "times", "first", "n", "whole", (F.col("whole") & (spot == F.col("least"))).alias("least"))
    kept = written(filed.join(again, ["symbol", "check"]).groupBy("key").agg(F.collect_list(stretch).alias("stretches")))
    discard(filed)
    discard(again)
    rows = written(printed(texts.join(kept, "key").select("key", "text", "stretches"), window))
    discard(kept)
    few = repeated_in_task(rows.where((F.col("times") > 0) & (F.col("times") <= TOGETHER)).drop("n").repartition("symbol"))
    many = repeated_by_count(rows.where(F.col("times") > TOGETHER).drop("n"))
    each = rows.where("times = 0").select("key", "first", "n").union(few).select("key", F.array(F.struct("first", "n")).alias("stretches")).union(many)
    found = written(each.groupBy("key").agg(F.flatten(F.collect_list("stretches")).alias("stretches")))
    discard(rows)
    return found


def covered(n_words: int, stretches: list[dict], window: int) -> np.ndarray:
    """Whether each word is in one of the windows."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    for s in stretches:
        edges[s["first"]] += 1
        edges[s["first"] + s["n"] - 1 + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def removal_plan(docs: DataFrame, text_col: str, window: int, rounds: int = ROUNDS) -> DataFrame:
    """key, text, copies and stretches (null: none) of each distinct text."""
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("key IS NOT NULL")
    texts = written(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    found = repeated_windows(texts.select("key", "text"), window, rounds)
    return texts.join(found, "key", "left")


def dedup_digest(docs: DataFrame, *, window: int = 35, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Each word goes that is covered by a window of `window` words that also starts elsewhere; windows
    are judged on the input, so all occurrences go, copies of a text included. A null or empty text
    has no words. Repeated rows are occurrences of each other. Other columns of `docs` are not read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copies, stretches in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("stretches"), strict=True):
                words = words_of(text.as_py())
                gone = _gone(words, copies, stretches.as_py(), window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                rows.append((len(words), int(gone.sum()), sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["key", "n_words", "n_removed", "kept_sha256"])

    plan = removal_plan(docs, text_col, window, rounds)
    by_text = plan.mapInArrow(digest, "key binary, n_words long, n_removed long, kept_sha256 string")
    keys = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    joined = keys.join(by_text, "key", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"))


def _gone(words: list[bytes], copies: int, stretches: list[dict] | None, window: int) -> np.ndarray:
    if copies > 1 and len(words) >= window:
        return np.ones(len(words), dtype=bool)
    return covered(len(words), stretches or [], window)


def remove_repeats(docs: DataFrame, *, window: int = 35, rounds: int = ROUNDS, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all their columns, with repeated passages cut out of the texts.

    A text that loses words becomes its kept words joined by single spaces; others stay as they are,
    null texts too. `count_col`, if given, is set to the characters of the new text.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, copies, stretches in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("stretches"), strict=True):
                words = words_of(text.as_py())
                gone = _gone(words, copies, stretches.as_py(), window)
                new.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(new, pa.string())], names=[key, changed_text])

    plan = removal_plan(docs, text_col, window, rounds)
    key, changed_text = unused(docs, "key"), unused(docs, "text")
    changed = plan.where(F.col("stretches").isNotNull() | (F.col("copies") > 1)).mapInArrow(rewrite, f"`{key}` binary, `{changed_text}` string")
    joined = docs.select("*", text_key(F.col(text_col)).alias(key)).join(changed, key, "left")
    text = F.coalesce(changed_text, text_col)
    columns = [text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == count_col else F.col(c) for c in docs.columns]
    return joined.select(*columns)
