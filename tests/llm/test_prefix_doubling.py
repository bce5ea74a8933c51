"""Removal of repeated byte strings against a plain count of all strings."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import prefix_doubling as doubling

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), spans, sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, tid int, key string, i int")
    return sorted([tuple(r) for r in doubling.doubling_digest(df, length=length).select(*COLUMNS).collect()], key=repr)


@pytest.mark.parametrize(("length", "chunk", "together"), [(50, 3000, 40), (97, 1 << 20, 1 << 17), (400, 3000, 400)])
def test_random_texts(spark, monkeypatch, length, chunk, together):
    """Passages, runs and periods joined at random, with copies, nulls and texts just too short and just long enough."""
    monkeypatch.setattr(doubling, "CHUNK", chunk)
    monkeypatch.setattr(doubling, "TOGETHER", together)
    rng = random.Random(length)
    pool = ["".join(rng.choice("abé") for _ in range(rng.choice([length // 2, length, 2 * length, 5 * length]))) for _ in range(6)]
    pool += ["a" * 3 * length, "ab" * 2 * length, "abcdefg" * length]
    rows = [(None, None), (1, ""), (2, "x" * (length - 1)), (3, "x" * length), (4, "y" * (length + 1)), (None, "z" * 3 * length)]
    for doc in range(10, 50):
        parts = [rng.choice(pool)[rng.randrange(20) :][: rng.randrange(3 * length)] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(length))) for _ in range(rng.randrange(7))]
        rows.append((doc, "".join(parts)))
    rows += rows[10:14]
    assert found(spark, rows, length) == plain(rows, length)


def test_empty_table_and_kept_bytes(spark):
    assert found(spark, [], 400) == []
    df = spark.createDataFrame([(1, "q" + "ab c" * 25 + "é1"), (2, "w" + "ab c" * 25 + "é2")], "doc_id int, text string")
    kept = {bytes(r["kept"]) for r in doubling.cut_repeats(df, length=100).collect()}
    assert kept == {b"q1", b"w2"}
    with pytest.raises(ValueError):
        doubling.reach_of(30)


def test_anchors_depend_on_what_lies_around_them():
    """A string of `length` bytes has the same anchors inside, whatever stands before and after it, and in whatever chunk."""
    rng = random.Random(2)
    inner = bytes(rng.randrange(97, 123) for _ in range(5000))
    places = []
    for _ in range(3):
        before = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(300, 900)))
        p = doubling.Phrases([b"x" * 50, before + inner + before[::-1]], 400)
        at = p.at[p.text == 1] - 50 - len(before)
        places.append([a for a in at.tolist() if p.reach <= a < len(inner) - p.reach - doubling.GRAM])
    assert places[0] and places[0] == places[1] == places[2]


def test_ranks_tell_equal_phrases(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    texts = spark.createDataFrame([(0, text[:3000]), (1, text[500:]), (2, text[::-1])], "tid long, text string")
    rounds, runs = doubling.doubled(texts, 400)
    assert runs.count() == 0
    assert len(rounds) > 2
    for ranks in rounds:
        times = ranks.groupBy("rank").agg(F.count("*").alias("n"), F.count_distinct("tid").alias("texts")).collect()
        assert times and all(r["n"] == 2 and r["texts"] == 2 for r in times)
        assert ranks.where("tid = 2").count() == 0
