"""Language identification with a byte convolutional network, trained here in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window
and classified by a softmax layer. A text is cut into such windows (the last is padded with zeros)
and the log-probabilities of all of them, weighted by their bytes, are averaged: every byte counts.

For application the embedding and the filters are multiplied out into one table of responses for
each pair of bytes, so a window costs a few table lookups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import unused

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Bound of the training sample: rows of each language, and characters taken of each.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 1500


def windows_of(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """Rows of `size` bytes; one row of zeros for an empty text."""
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b"\0"), dtype=np.uint8).reshape(n, size)


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the responses to the byte pairs (and for an odd width the last byte) of a position."""
        found = []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embed @ weights[j * EMBEDDING : (j + 1) * EMBEDDING]).astype(np.float32) for j in range(width)]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, width - 1, 2)]
            found.append(pairs + single[width - 1 :] * (width % 2))
        return found


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Scorer:
    """Applies a network to windows of many texts at once."""

    def __init__(self, net: ByteNet):
        self.net, self.tables = net, net.tables()

    def windows(self, rows: np.ndarray, step: int = 128) -> np.ndarray:
        """Log-probabilities, one line for each row of bytes."""
        pooled = np.empty((len(rows), len(WIDTHS) * FILTERS), dtype=np.float32)
        for at in range(0, len(rows), step):
            part = rows[at : at + step].astype(np.int32)
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            for k, (width, tables) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                n = WINDOW - width + 1
                response = None
                for j, lookup in enumerate(tables):
                    index = pairs if len(lookup) == 65536 else part
                    got = lookup.take(index[:, 2 * j : 2 * j + n], axis=0)
                    response = got if response is None else np.add(response, got, out=response)
                pooled[at : at + step, k * FILTERS : (k + 1) * FILTERS] = response.max(axis=1) + self.net.biases[k]
        return log_softmax(np.maximum(pooled, 0) @ self.net.out + self.net.out_bias)

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, its probability) of each text."""
        raw = [text.encode() for text in texts]
        counts = np.array([max(1, -(-len(r) // WINDOW)) for r in raw])
        total = np.zeros((len(raw), len(self.net.languages)))
        first = 0
        while first < len(raw):  # as many whole texts as make some thousand windows
            last, rows = first, 0
            while last < len(raw) and (rows == 0 or rows + counts[last] <= 4096):
                rows += counts[last]
                last += 1
            scores = self.windows(np.concatenate([windows_of(r) for r in raw[first:last]]))
            for i, part in zip(range(first, last), np.split(scores, np.cumsum(counts[first:last])[:-1]), strict=True):
                weight = np.full(len(part), WINDOW, dtype=float)
                weight[-1] = max(1, len(raw[i]) - WINDOW * (len(part) - 1))
                total[i] = weight @ part / weight.sum()
            first = last
        probability = np.exp(log_softmax(total))
        return [self.net.languages[i] for i in probability.argmax(axis=1)], probability.max(axis=1)


def train(texts: list[str], labels: list[str], *, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 1) -> ByteNet:
    """Fit the network by Adam on random windows, of 8 to `WINDOW` bytes, of the labelled texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    by_language = [[t.encode() for t, l in zip(texts, labels, strict=True) if l == name and t] or [b""] for name in languages]
    shapes = [(256, EMBEDDING), *((w * EMBEDDING, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS, k), (k,)]
    params = [rng.normal(0, 1 / np.sqrt(s[0]) if len(s) == 2 and s[0] != 256 else 0.3 if len(s) == 2 else 0, s) for s in shapes]
    moment, spread = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    n_widths = len(WIDTHS)
    for step in range(1, steps + 1):
        chosen = rng.integers(0, k, batch)
        rows = np.zeros((batch, WINDOW), dtype=np.uint8)
        for i, c in enumerate(chosen):
            raw = by_language[c][rng.integers(len(by_language[c]))]
            size = int(min(len(raw), WINDOW, 8 * 2 ** rng.uniform(0, 5)))
            start = int(rng.integers(0, len(raw) - size + 1))
            rows[i, :size] = np.frombuffer(raw[start : start + size], dtype=np.uint8)
        embed, filters, biases, out, out_bias = params[0], params[1 : 1 + n_widths], params[1 + n_widths : 1 + 2 * n_widths], params[-2], params[-1]
        vectors = embed[rows]
        pooled, where, patches = [], [], []
        for width, weights, bias in zip(WIDTHS, filters, biases, strict=True):
            seen = np.lib.stride_tricks.sliding_window_view(vectors, width, axis=1).transpose(0, 1, 3, 2).reshape(batch, WINDOW - width + 1, width * EMBEDDING)
            response = seen @ weights + bias
            at = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
            where.append(at)
            patches.append(seen)
        before = np.concatenate(pooled, axis=1)
        hidden = np.maximum(before, 0)
        error = np.exp(log_softmax(hidden @ out + out_bias))
        error[np.arange(batch), chosen] -= 1
        error /= batch
        grads = [np.zeros(s) for s in shapes]
        grads[-2], grads[-1] = hidden.T @ error, error.sum(axis=0)
        back = (error @ out.T) * (before > 0)
        lines = np.arange(batch)[:, None]
        for j, width in enumerate(WIDTHS):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            picked = patches[j][lines, where[j]]  # batch, filter, width * embedding
            grads[1 + j] = np.einsum("bfe,bf->ef", picked, g)
            grads[1 + n_widths + j] = g.sum(axis=0)
            into = np.einsum("bf,ef->bfe", g, filters[j]).reshape(batch, FILTERS, width, EMBEDDING)
            letters = rows[lines[:, :, None], where[j][:, :, None] + np.arange(width)]
            np.add.at(grads[0], letters.ravel(), into.reshape(-1, EMBEDDING))
        for i, g in enumerate(grads):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            spread[i] = 0.999 * spread[i] + 0.001 * g * g
            params[i] = params[i] - rate * (1 - step / (steps + 1)) * (moment[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, params[0], params[1 : 1 + n_widths], params[1 + n_widths : 1 + 2 * n_widths], params[-2], params[-1])


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text, modulo `folds`, is `fold`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def bar_of(n: int, rows: int) -> int:
    """Hashes (of 62 bits) below it take part in the draw from `n` rows: three times the wanted `rows` are expected."""
    return int((1 << 62) * min(1.0, 3 * rows / n))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, label) of at most `rows` rows of each label, chosen by hash, and `chars` characters of each from a place chosen by hash."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 2)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), hashed.alias("place"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    bars = F.create_map([F.lit(x) for name, n in sizes.items() for x in (name, bar_of(n, rows))])
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    few = labelled.where(F.col("place") < bars[F.col("label")]).select("label", "place", F.col("text").substr(start, F.lit(chars)).alias("text"))
    ranked = few.withColumn("_rank", F.row_number().over(W.partitionBy("label").orderBy("place", "text"))).where(F.col("_rank") <= rows)
    return [(r["text"], r["label"]) for r in ranked.orderBy("label", "_rank").collect()]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold; None without any."""
    sample = training_sample(docs.where(~in_fold(id_col, folds, held_out)), id_col=id_col, text_col=text_col, label_col=label_col, rows=rows)
    return train([t for t, _ in sample], [l for _, l in sample]) if sample else None


def with_language(docs: DataFrame, net: ByteNet | None, *, text_col: str = "text", lang_col: str = "_lang", score_col: str = "_score") -> DataFrame:
    """`docs` with a predicted language and its probability: `und` and 0 for a text that is null or has no letter, or without a network.

    `docs` must not have columns of the two names (`unused` finds such names); an error otherwise.
    """
    if taken := {c.lower() for c in docs.columns} & {lang_col.lower(), score_col.lower()}:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    if net is None:
        return docs.withColumns({lang_col: F.lit("und"), score_col: F.lit(0.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    flagged = docs.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(unused(docs, "letters")))
    at = docs.columns.index(text_col)
    schema = docs.limit(0).withColumns({lang_col: F.lit("und"), score_col: F.lit(0.0)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            named, sure = scorer.texts([t.as_py() for t, has in zip(batch.column(at), letters, strict=True) if has]) if any(letters) else ([], [])
            found = iter(zip(named, sure, strict=True))
            pairs = [next(found) if has else ("und", 0.0) for has in letters]
            columns = [*batch.columns[:-1], pa.array([p[0] for p in pairs], pa.string()), pa.array([float(p[1]) for p in pairs], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return flagged.mapInArrow(predict, schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by whole texts; see `fit` and `with_language`."""
    net = fit(docs, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_out=held_out)
    narrow = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, folds, held_out).alias("held_out"), F.col(text_col).alias("text"))
    return with_language(narrow, net).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def drop_unidentified(docs: DataFrame, *, least: float = 0.5, languages: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all their columns, whose predicted language is likelier than `least`.

    With the default, a row goes if no language is likelier than all others together; so do rows
    without text or letters (`und`), and rows predicted to be in none of `languages`, if given.
    """
    net = fit(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    lang, score = unused(docs, "lang"), unused(docs, "score")
    keep = (F.col(lang) != "und") & (F.col(score) > least)
    if languages is not None:
        keep &= F.col(lang).isin(languages)
    return with_language(docs, net, text_col=text_col, lang_col=lang, score_col=score).where(keep).select(*docs.columns)
