"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task keeps at most `open_bins` unfinished sequences. A bitset has
bit f set while a sequence with f free places is open, so the best fit of a piece of length n is the
lowest set bit from n on. When one more sequence would exceed the bound, the fullest is closed.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END_OF_TEXT = "<|endoftext|>"


@cache
def encoder(vocabulary: str):
    """The byte-level BPE named `vocabulary`, once a worker.

    The ranks file of a vocabulary gives the same ids as its JSON file (a test compares them) at a
    quarter of the CPU time.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def cut_lengths(total: int, max_len: int) -> list[int]:
    """Lengths of a document's pieces: full ones, and the rest first."""
    full, rest = divmod(total, max_len)
    return [rest] * (rest > 0) + [max_len] * full


class OpenBins:
    """The unfinished sequences of one task."""

    def __init__(self, max_len: int, open_bins: int):
        self.max_len, self.open_bins = max_len, open_bins
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(max_len + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence number, offset there) of the next piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.max_len, self.made
            self.made += 1
        left = free - length
        if left:
            held = self.by_free[left]
            if not held:
                self.bits |= 1 << left
            held.append(number)
            self.count += 1
        return number, self.max_len - free


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", max_len: int = 2048, eos: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts (null: empty), append `eos`, cut what is longer than `max_len`."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", narrow.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            row, number, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or "", allowed_special="all"), eos).astype("<u4")
                at = 0
                for n, size in enumerate(cut_lengths(len(ids), max_len)):
                    part = ids[at : at + size]
                    row.append(i)
                    number.append(n)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(tokenise, schema)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", max_len: int = 2048, eos: int = 0, open_bins: int = 8192, with_ids: bool = False) -> DataFrame:
    """Place every piece of every document: adds sequence_id and offset to `pieces`.

    Only the short descriptions of pieces are shuffled, in an order that mixes lengths; Spark sizes
    the packing tasks by those bytes, so each has very many pieces and wastes at most its last
    `open_bins` sequences. The pieces of one Arrow batch, a bounded look-ahead, are placed longest
    first. Rows are independent: repeated rows and null ids are packed like others,
    a null or empty text is the single id `eos`, an empty table gives no rows. Other columns of
    `docs` are not read.
    """
    cut = pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, max_len=max_len, eos=eos, with_ids=with_ids)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names, order = cut.columns, F.xxhash64(F.monotonically_increasing_id(), "ids_crc32")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(max_len, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            places = np.empty((len(lengths), 2), dtype=np.int64)
            places[order] = [bins.place(n) for n in lengths[order].tolist()]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places[:, 0] + first), pa.array(places[:, 1])], names=schema.names)

    dealt = cut.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order")
    return dealt.mapInArrow(place, schema)
