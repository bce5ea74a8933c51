"""Language-model scoring with Brown class-based bigrams.

P(word | previous) = P(class of word | class of previous) * P(word | class of word). Words get their
classes by exchange clustering: words move between classes while that raises the likelihood of the
corpus' class bigrams. Counts of words and of word bigrams cover all training documents and are
gathered by Spark. Exchange first runs in turn over the most frequent words and over groups of the
others by their ending, which places the classes; then every word of the dictionary is exchanged on
its own, in Spark rounds in which one half of the words moves at once. Only words too rare for the
dictionary share the class of their ending.

Scoring needs the exact count of every word. The most frequent words go out in a dictionary of
bounded size; all others are joined to their counts in a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import lower_words_of as words_of
from waymark.llm.common import discard, written

#: The end of a text as a word: no word is empty.
END = b""
#: Words that are exchanged in turn, endings, classes, and Spark rounds over all words of the dictionary.
FREQUENT, ENDINGS, CLASSES, ROUNDS = 768, 256, 64, 4
#: Words in the dictionary that goes to all tasks.
DICTIONARY = 200_000
#: Words a task counts before it hands its counts on.
HELD_WORDS = 300_000
ADD = 0.1


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(texts: DataFrame) -> DataFrame:
    """word binary, n long over a one-column table of texts; each text ends with the word END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def neighbours(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """unit, and as packed numbers what follows it (after, after_n) and precedes it (before, before_n), with counts, over all texts.

    A word of `words` is the unit of its number; others are `len(words)` plus the number of their
    ending. END stands before and after each text. Tasks count stretches of tokens and hand on a row
    for each unit and side; a row of the result has no more neighbours than there are units.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shipped.value)}
        base, end = len(number), number[END]

        def sums(sequence: list[int]) -> Iterator[pa.RecordBatch]:
            ids = np.array(sequence, dtype=np.int64)
            for side, codes in enumerate((ids[:-1] << 32 | ids[1:], ids[1:] << 32 | ids[:-1])):
                codes, n = np.unique(codes, return_counts=True)
                unit = codes >> 32
                first = np.flatnonzero(np.diff(unit, prepend=-1))
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(unit[first].astype(np.int32)), pa.array(np.full(len(first), side, np.int32)), _packed((codes & 0xFFFFFFFF).astype("<i4"), first), _packed(n.astype("<i8"), first)], names=["unit", "side", "other", "n"])

        sequence = [end]
        for batch in batches:
            for text in batch.column(0):
                for word in words_of(text.as_py()):
                    at = number.get(word)
                    sequence.append(base + ending(word) if at is None else at)
                sequence.append(end)
                if len(sequence) > 2_000_000:
                    yield from sums(sequence)
                    sequence = [end]
        yield from sums(sequence)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, waiting = [], [], 0

        def settled() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate([np.empty(0, "<i8"), *counts]), minlength=len(code)).astype("<i8")

        for batch in batches:
            row, other, n = _unpacked(batch.column(2), batch.column(3))
            key = batch.column(0).to_numpy().astype(np.int64) << 1 | batch.column(1).to_numpy()
            codes.append(key[row] << 32 | other)
            counts.append(n)
            waiting += len(n)
            if waiting > 8_000_000:
                code, n = settled()
                codes, counts, waiting = [code], [n], 0
        code, n = settled()
        key, other = code >> 32, (code & 0xFFFFFFFF).astype("<i4")
        units = np.unique(key >> 1)
        for at in range(0, len(units), 2000):
            part = units[at : at + 2000]
            bounds = np.searchsorted(key, np.stack([part << 1, part << 1 | 1, (part + 1) << 1], axis=1))
            columns = [pa.array([values[low:high].tobytes() for low, high in zip(bounds[:, side].tolist(), bounds[:, side + 1].tolist(), strict=True)], pa.binary()) for side in (0, 1) for values in (other, n)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *columns], names=["unit", "after", "after_n", "before", "before_n"])

    counted = texts.mapInArrow(count, "unit int, side int, other binary, n binary")
    return counted.repartition("unit").mapInArrow(merge, "unit int, after binary, after_n binary, before binary, before_n binary")


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Stretches of `values` that begin at `first`, as bytes."""
    offsets = (np.append(first, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(other: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, n) of two columns of packed numbers."""
    blobs = other.to_pylist()
    sizes = np.fromiter((len(x) // 4 for x in blobs), dtype=np.int64, count=len(blobs))
    return np.repeat(np.arange(len(blobs)), sizes), np.frombuffer(b"".join(blobs), "<i4"), np.frombuffer(b"".join(n.to_pylist()), "<i8")


def grouped_matrix(near: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of groups, `group` of each unit, as a matrix of `size` lines."""
    shipped = near.sparkSession.sparkContext.broadcast(group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shipped.value, np.zeros(size * size)
        for batch in batches:
            row, other, n = _unpacked(batch.column(1), batch.column(2))
            total += np.bincount(of[batch.column(0).to_numpy()][row] * size + of[other], weights=n, minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["cell", "n"])

    cells = near.select("unit", "after", "after_n").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size, dtype=np.int64)
    matrix[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return matrix.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, end: int, classes: int = CLASSES, sweeps: int = 6) -> np.ndarray:
    """Class of each unit: in turn, each moves to the class that gives the class bigrams the highest likelihood.

    Unit `end` has class 0 to itself; units start in the others by their frequency.
    """
    size = len(bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u != end]
    of = np.zeros(size, dtype=np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    one_hot = np.eye(classes)[of]
    after, before = bigrams @ one_hot, bigrams.T @ one_hot  # per unit: what follows and what precedes, by class
    pairs = one_hot.T @ after
    free = np.arange(1, classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            old, own = of[u], float(bigrams[u, u])
            right, left = after[u].copy(), before[u].copy()
            pairs[old] -= right
            pairs[:, old] -= left
            pairs[old, old] += own
            right[old] -= own
            left[old] -= own
            kept, diagonal = xlogx(pairs), np.diagonal(pairs)
            gain_rows = xlogx(pairs + right) - kept
            gain_columns = xlogx(pairs + left[:, None]) - kept
            gain = gain_rows.sum(axis=1) + gain_columns.sum(axis=0) - np.diagonal(gain_rows) - np.diagonal(gain_columns)
            gain += xlogx(diagonal + right + left + own) - xlogx(diagonal)
            out, into = pairs.sum(axis=1), pairs.sum(axis=0)
            gain -= xlogx(out + right.sum() + own) - xlogx(out) + xlogx(into + left.sum() + own) - xlogx(into)
            new = int(free[np.argmax(gain[1:])])
            if gain[new] <= gain[old] + 1e-9:
                new = old
            right[new] += own
            left[new] += own
            pairs[new] += right
            pairs[:, new] += left
            pairs[new, new] -= own
            if new != old:
                moved += 1
                of[u] = new
                after[:, old] -= bigrams[:, u]
                after[:, new] += bigrams[:, u]
                before[:, old] -= bigrams[u]
                before[:, new] += bigrams[u]
        if not moved:
            break
    return of


def moves(of: np.ndarray, pairs: np.ndarray, unit: np.ndarray, sides: tuple) -> np.ndarray:
    """The class each of `unit` is best in, all others staying, from what follows and what precedes them (row: which unit, other, n).

    What a unit adds to the sum of x log x over the class bigrams, less that over classes, is
    compared between its own class (without it) and the others; class 0 is END's own.
    """
    classes = len(pairs)
    dense = np.stack([np.bincount(row * classes + of[other], weights=n, minlength=len(unit) * classes).reshape(-1, classes) for row, other, n in sides], axis=1)
    who, before, c = np.nonzero(dense)
    v, before = dense[who, before, c][:, None], before == 1
    there = np.where(before[:, None], pairs[c], pairs[:, c].T)  # a line of bigram counts by class, for each cell
    own = of[unit[who]]
    gain = xlogx(there + v) - xlogx(there)
    lines = np.arange(len(who))
    stay = there[lines, own]
    gain[lines, own] = xlogx(stay) - xlogx(np.maximum(stay - v[:, 0], 0))
    total = np.zeros((len(unit), classes))
    np.add.at(total, who, gain)
    for is_before, marginal in ((False, pairs.sum(axis=1)), (True, pairs.sum(axis=0))):
        mass = np.bincount(who[before == is_before], weights=v[before == is_before, 0], minlength=len(unit))[:, None]
        loss = xlogx(marginal + mass) - xlogx(np.broadcast_to(marginal, (len(unit), classes)))
        home = marginal[of[unit]]
        loss[np.arange(len(unit)), of[unit]] = xlogx(home) - xlogx(np.maximum(home - mass[:, 0], 0))
        total -= loss
    best = 1 + total[:, 1:].argmax(axis=1)
    better = total[np.arange(len(unit)), best] > total[np.arange(len(unit)), of[unit]] + 1e-9
    return np.where(better & (of[unit] != 0), best, of[unit])


def exchange_words(near: DataFrame, of: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each unit of `near`: in each round the even or the odd half moves, by Spark, to the best classes."""
    of = of.copy()
    for number in range(rounds):
        shipped = near.sparkSession.sparkContext.broadcast((of, grouped_matrix(near, of, classes).astype(float)))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, counts = shipped.value
            for batch in batches:
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    unit = part.column(0).to_numpy()
                    new = moves(now, counts, unit, tuple(_unpacked(part.column(i), part.column(i + 1)) for i in (1, 3)))
                    moved = new != now[unit]
                    yield pa.RecordBatch.from_arrays([pa.array(unit[moved]), pa.array(new[moved].astype(np.int32))], names=["unit", "class"])

        found = near.where(F.col("unit") % 2 == number % 2).mapInArrow(move, "unit int, class int").toArrow()
        of[found.column("unit").to_numpy()] = found.column("class").to_numpy()
    return of


@dataclass
class ClassModel:
    """tokens N and words V of the training texts, and the smoothed model; `counts` holds the dictionary's words, END first."""

    tokens: int
    words: int
    of: np.ndarray  # class of each word of the dictionary, then of each ending
    transition: np.ndarray
    emission_base: np.ndarray
    counts: dict[bytes, int]


def fit(texts: DataFrame, *, classes: int = CLASSES, frequent: int = FREQUENT, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """(model, table of all words' counts) of a one-column table of training texts."""
    counts = written(count_words(texts))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    level = F.floor(F.log2("n") * 16)  # words by the order of their counts
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    bar, room = None, dictionary
    for value, words in levels:
        if words > room:
            break
        bar, room = value, room - words
    found = {} if bar is None else {bytes(r["word"]): r["n"] for r in counts.where(level >= bar).collect()}
    order = sorted((w for w in found if w != END), key=lambda w: (-found[w], w))
    known = {END: found.get(END, 0)} | {w: found[w] for w in order}
    words = list(known)
    near = written(neighbours(texts, words))

    endings = np.fromiter(map(ending, words), dtype=np.int64, count=len(words))
    alone = min(len(words), frequent + 1)
    group = np.concatenate([np.arange(alone), alone + endings[alone:], alone + np.arange(ENDINGS)])
    of = exchange(grouped_matrix(near, group, alone + ENDINGS), 0, classes)[group]
    of = exchange_words(near, of, classes, rounds)

    bigrams = grouped_matrix(near, of, classes)
    discard(near)
    into = bigrams.sum(axis=0)
    prior = (into + 1) / (into.sum() + classes)
    transition = np.log10((bigrams + classes * prior) / (bigrams.sum(axis=1, keepdims=True) + classes))

    by_ending = np.zeros(ENDINGS)  # distinct words of each ending, without the dictionary's
    last = F.when(F.length("word") > 3, F.expr("substring(word, -3, 3)")).otherwise(F.col("word"))
    for row in counts.where(F.length("word") > 0).groupBy((F.crc32(last) % ENDINGS).alias("ending")).agg(F.count(F.lit(1)).alias("words")).collect():
        by_ending[row["ending"]] = row["words"]
    by_ending -= np.bincount(endings[1:], minlength=ENDINGS)
    distinct = np.bincount(of, weights=np.concatenate([np.ones(len(words)), np.maximum(by_ending, 0)]), minlength=classes)
    emission_base = np.log10(into + ADD * (distinct + 1))
    return ClassModel(total["tokens"], total["words"], of, transition, emission_base, known), counts


def score_documents(docs: DataFrame, is_training: Column, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, frequent: int = FREQUENT, dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> DataFrame:
    """Score every whole text by a model of the training texts.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score, both
    log10 probabilities. A text is its words and one end; a null text is empty. Words unknown to
    training share one place in each class, as all of them share one place in the base. Rows are
    independent: repeated rows and null ids are scored like others. Without training texts every
    token has probability 1 in the base.
    """
    spark: SparkSession = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(is_training, F.lit(False)).alias("training"))
    model, counts = fit(narrow.where("training").select("text"), classes=classes, frequent=frequent, dictionary=dictionary, rounds=rounds)
    shipped = spark.sparkContext.broadcast(model)
    id_type = narrow.schema["doc_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (word null) for each text with what the dictionary gives, and one for each other word of it."""
        m = shipped.value
        number = {w: i for i, w in enumerate(m.counts)}
        logs = np.log10(np.fromiter(m.counts.values(), dtype=float, count=len(m.counts)) + ADD)
        all_base = np.log10(m.tokens + ADD * (m.words + 1))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, tokens, knowns, bases, scores = [], [], [], [], []
            rare_keys, rare_words, rare_times = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                words.append(END)
                at = np.fromiter((number.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                known = at >= 0
                unit = at.copy()
                unit[~known] = [len(number) + ending(words[i]) for i in np.flatnonzero(~known)]
                kinds = m.of[unit]
                before = np.concatenate(([0], kinds[:-1]))
                at[at == 0] = 0 if m.counts[END] else -1
                known = at >= 0
                logged = logs[at[known]].sum()
                keys.append(row)
                tokens.append(len(words))
                knowns.append(int(known.sum()))
                bases.append(logged - len(words) * all_base)
                scores.append(logged + m.transition[before, kinds].sum() - m.emission_base[kinds].sum())
                rare = Counter(words[i] for i in np.flatnonzero(~known))
                rare_keys.extend([row] * len(rare))
                rare_words.extend(rare.keys())
                rare_times.extend(rare.values())
                row += 1
            n, r = len(keys), len(rare_keys)
            ids = pa.concat_arrays([batch.column(0), pa.nulls(r, batch.column(0).type)])
            training = pa.concat_arrays([batch.column(2), pa.nulls(r, pa.bool_())])
            yield pa.RecordBatch.from_arrays([pa.array(keys + rare_keys, pa.int64()), ids, training, pa.array([None] * n + rare_words, pa.binary()), pa.array(tokens + rare_times, pa.int64()), pa.array(knowns + [None] * r, pa.int64()), pa.array(bases + [None] * r, pa.float64()), pa.array(scores + [None] * r, pa.float64())], names=["row", "doc_id", "training", "word", "times", "known", "base", "score"])

    read_rows = written(narrow.mapInArrow(read, f"row long, doc_id {id_type.simpleString()}, training boolean, word binary, times long, known long, base double, score double"))
    rare = read_rows.where("word IS NOT NULL").select("row", "word", "times")
    logs = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0)).alias("rare_known"))
    texts = read_rows.where("word IS NULL").drop("word").join(logs, "row", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    return texts.select("doc_id", (~F.col("training")).alias("held_out"), F.col("times").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
