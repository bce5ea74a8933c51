"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of every normalised test item. A document's words are streamed
through it and the length of the longest match that ends at each word is tracked; where that length
reaches the window, the words of the window are hit. A word that no item has sends the automaton to
its root, so only stretches of known words are walked.

An automaton holds a bounded part of the items. One part is the rule; of more, each takes its own
pass over the documents and adds its hits to those of the passes before, which is exact: a word is hit
if any item's window covers it, whichever part the item is in.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, unused, written

#: Bytes of test items that one automaton holds: it is built on the driver and broadcast. While it is
#: built it takes about 140 bytes a byte.
PART_BYTES = 4 << 20

#: Bytes of a word: 0-9, a-z and all of other characters; A-Z become a-z, the rest separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Of each text: hit or not, for each word; the items with a window in it.
Matches = list[tuple[np.ndarray, set[str]]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All substrings of `items`, (id, words) each, with what streaming needs at each state.

    Once built, a state with one way out has it in two arrays; only the others keep a dictionary.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.alphabet = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seen: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for item, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self._extend(state, self.alphabet.setdefault(word, len(self.alphabet)))
                if i + 1 >= window:
                    seen.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                whole.setdefault(state, set()).add(item)
        self._index(seen, whole)
        self._pack()

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the longest string of p and `word`, split off from a longer one if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, word)
        return state

    def _index(self, seen: dict[int, set[str]], whole: dict[int, set[str]]) -> None:
        """within: the items that hold the last `window` words of a match; short: (length, item) of whole short items that end a match."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(order):
            up = self.link[v]
            if v in seen and self.length[up] >= self.window:
                seen.setdefault(up, set()).update(seen[v])
        self.sets: list[frozenset[str]] = []
        self.within = array("i", repeat(-1, len(self.length)))
        numbers: dict[frozenset[str], int] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                if self.length[up] >= self.window:
                    self.within[v] = self.within[up]
                else:
                    items = frozenset(seen[v])
                    self.within[v] = numbers.setdefault(items, len(numbers))
            if ends := [*self.short.get(up, []), *((self.length[v], item) for item in sorted(whole.get(v, ())))]:
                self.short[v] = ends
        self.sets.extend(numbers)
        self.least = min([self.window, *(self.length[v] for v in whole)])

    def _pack(self) -> None:
        """word, to: the way out of a state that has one; ways: those of all others."""
        self.word, self.to = array("i", repeat(-1, len(self.next))), array("i", repeat(-1, len(self.next)))
        self.ways: dict[int, dict[int, int]] = {}
        for state, following in enumerate(self.next):
            if len(following) == 1:
                ((self.word[state], self.to[state]),) = following.items()
            elif following:
                self.ways[state] = following
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def stream(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(hit or not, for each word; the items with a window in `words`)."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        known = np.fromiter(map(self.alphabet.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.least:
                self._walk(known[begin:end].tolist(), begin, hit, found)
        return hit, found

    def _walk(self, stretch: list[int], begin: int, hit: np.ndarray, found: set[str]) -> None:
        only, to, ways, link, length, window = self.word, self.to, self.ways, self.link, self.length, self.window
        none: dict[int, int] = {}
        state = matched = 0
        for i, word in enumerate(stretch, begin + 1):
            # The root has a way out with every known word, so the search ends there.
            while (following := to[state] if only[state] == word else ways.get(state, none).get(word, -1)) < 0:
                state = link[state]
                matched = length[state]
            state = following
            matched += 1
            if matched >= window:
                hit[i - window : i] = True
                found |= self.sets[self.within[state]]
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    hit[i - size : i] = True
                    found.add(item)


def contaminated(n_hit: int, n_words: int, coverage: int = 20) -> bool:
    """At least one word in `coverage` is hit."""
    return n_hit > 0 and coverage * n_hit >= n_words


def parts_of(items: Iterable[tuple[str, str]], window: int, most: int = PART_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items of at most about `most` bytes together; an empty list if there are none.

    An item with more goes in pieces that share window - 1 words, so every window is in one of them.
    """
    part: list[tuple[str, list[bytes]]] = []
    size = given = 0
    for item, text in items:
        words = words_of(text)
        stride = len(words) if len(text) <= most else max(window, most // 8)
        for at in range(0, max(len(words) - window + 1, 1), max(stride, 1)):
            piece = words[at : at + stride + window - 1]
            weight = sum(map(len, piece)) + len(piece)
            if part and size + weight > most:
                yield part
                part, size, given = [], 0, given + 1
            part.append((item, piece))
            size += weight
    if part or not given:
        yield part


def automata(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[SuffixAutomaton]:
    """One automaton after the other over parts of the test items; items without id or text have no windows."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    rows = items.orderBy("item", "text").toLocalIterator()
    for part in parts_of(((r["item"], r["text"]) for r in rows), window, PART_BYTES):
        yield SuffixAutomaton(part, window)


def _streamed(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, finish: Callable[[pa.RecordBatch, Matches], pa.RecordBatch], schema) -> DataFrame:
    """What `finish` makes of each batch of `docs` and of the (hits, items) of its texts.

    A pass that others follow writes its hits, as bits, and items beside the columns of `docs`.
    """
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    hits, items = unused(docs, "hits"), unused(docs, "items")
    width, before = len(docs.columns), None

    def matches(batch: pa.RecordBatch, automaton: SuffixAutomaton) -> Matches:
        rows = []
        for i, text in enumerate(batch.column(at)):
            hit, found = automaton.stream(words_of(text.as_py()))
            if batch.num_columns > width:
                hit |= np.unpackbits(np.frombuffer(batch.column(width)[i].as_py(), dtype=np.uint8), count=len(hit)).view(bool)
                found |= set(batch.column(width + 1)[i].as_py())
            rows.append((hit, found))
        return rows

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])

    def last(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(own(batch), matches(batch, shipped.value))

        return run

    def between(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = matches(batch, shipped.value)
                added = [pa.array([np.packbits(h).tobytes() for h, _ in rows], pa.binary()), pa.array([sorted(f) for _, f in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], names=[*batch.schema.names[:width], hits, items])

        return run

    bits = docs.select("*", F.lit(b"").alias(hits), F.array(F.lit("")).alias(items)).schema
    parts = automata(benchmark, window, item_col, item_text_col)
    automaton = next(parts)
    for following in parts:
        shipped = sc.broadcast(automaton)
        docs = written(docs.mapInArrow(between(shipped), bits))
        shipped.destroy()
        if before is not None:
            discard(before)
        before, automaton = docs, following
    return docs.mapInArrow(last(sc.broadcast(automaton)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document its words, hit words, items found and verdict; a single pass without a shuffle.

    A window is `window` consecutive words of an item, or all of a shorter item. A null or empty
    text has no words and is clean; repeated rows are judged alike; an empty benchmark hits nothing.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def judge(batch: pa.RecordBatch, matches: Matches) -> pa.RecordBatch:
        rows = []
        for hit, found in matches:
            n_hit = int(np.count_nonzero(hit))
            rows.append((len(hit), n_hit, len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), contaminated(n_hit, len(hit))))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return _streamed(narrow, benchmark, window, "text", item_col, item_text_col, judge, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, whose text is not contaminated; the others go whole."""

    def keep(batch: pa.RecordBatch, matches: Matches) -> pa.RecordBatch:
        return batch.filter(pa.array([not contaminated(int(np.count_nonzero(h)), len(h)) for h, _ in matches], pa.bool_()))

    return _streamed(docs, benchmark, window, text_col, item_col, item_text_col, keep, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` with hit spans cut out of the text: from a hit run's first word to its last.

    The characters outside the spans stay as they are. Null texts stay null.
    """
    at = docs.columns.index(text_col)

    def cut(text: str | None, hit: np.ndarray) -> str | None:
        raw = (text or "").encode()
        if not hit.any():
            return text
        is_word = np.frombuffer(raw.translate(WORD_BYTES), dtype=np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
        runs = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        kept, done = [], 0
        for first, after in zip(runs[::2], runs[1::2], strict=True):
            kept.append(raw[done : edges[2 * first]])
            done = edges[2 * after - 1]
        return b"".join([*kept, raw[done:]]).decode()

    def rewrite(batch: pa.RecordBatch, matches: Matches) -> pa.RecordBatch:
        texts = pa.array([cut(text.as_py(), hit) for text, (hit, _) in zip(batch.column(at), matches, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return _streamed(docs, benchmark, window, text_col, item_col, item_text_col, rewrite, docs.schema)
