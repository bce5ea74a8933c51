"""The contract queries on the smallest tables: against SQL, or against a plain version."""

import zlib
from collections import Counter
from math import log10

import pytest
from tests.oracle import SF, connect, of_frame, of_sql

from waymark.llm import lm_scoring, packing
from waymark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert of_frame(QUERIES[name](spark, SF)) == of_sql(connect(), ORACLES[name])


@pytest.fixture(scope="module")
def texts():
    return dict(connect().sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = QUERIES["op1_best_fit_packing"](spark, SF).toPandas()
    for doc, rows in found.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0]
        rows = rows.sort_values("piece")
        assert rows["piece"].tolist() == list(range(len(rows)))
        assert rows["length"].sum() == len(ids)
        assert len(rows) == 1 or len(ids) > 2048
        at = 0
        for row in rows.itertuples():
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + row.length])
            assert (row.start, row.ids_crc32) == (at, zlib.crc32(part))
            at += row.length
    assert set(found["doc_id"]) == set(texts)
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() <= 2048
    assert found["sequence_id"].nunique() <= 1.05 * -(-found["length"].sum() // 2048) + 4


def test_best_fit_takes_the_fullest_that_fits():
    bins = packing.OpenBins(10, 3)
    assert [bins.place(n) for n in (4, 7, 3, 6, 9)] == [(0, 0), (1, 0), (1, 7), (0, 4), (2, 0)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (5, 6, 8, 2, 4)] == [0, 1, 2, 2, 0]  # bin 1, the fullest, closed for bin 2


def test_scores(spark, texts):
    def words(text):
        return [w.decode() for w in text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in [*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    model, _ = lm_scoring.fit(spark.createDataFrame([(t,) for d, t in texts.items() if not held[d]], "text string"))
    of = {w: int(model.of[i]) for i, w in enumerate(model.counts)}
    assert {w.decode() for w in of} == {w for w in counts if w != "\0end"} | {""} and len({*of.values()}) > 32

    def kind(word):
        raw = b"" if word == "\0end" else word.encode()
        return of[raw] if raw in of else int(model.of[len(of) + lm_scoring.ending(raw)])

    gains = []
    for r in QUERIES["op3_class_lm_scoring"](spark, SF).collect():
        tokens = [*words(texts[r["doc_id"]]), "\0end"]
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        kinds = [0, *map(kind, tokens)]
        plain = sum(model.transition[a, b] + log10(counts[w] + 0.1) - model.emission_base[b] for a, b, w in zip(kinds, kinds[1:], tokens))
        assert r["score"] == pytest.approx(plain, abs=1e-6)
        if r["held_out"]:
            gains.append(r["score"] - r["base_score"])
    assert sum(gains) > 0  # classes predict held-out text better than words alone


def test_languages_of_held_out_texts(spark):
    known = dict(connect().sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND n_chars > 40").fetchall())
    found = [(r["lang_pred"], known[r["doc_id"]]) for r in QUERIES["op7_language_id"](spark, SF).collect() if r["held_out"] and r["doc_id"] in known and r["lang_pred"] != "und"]
    assert sum(a == b for a, b in found) > 0.95 * len(found)


def test_shards(spark, texts):
    rows = QUERIES["op10_feistel_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    shards = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(16))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert rows == QUERIES["op10_feistel_sharding"](spark, SF).collect() or sorted(map(tuple, rows), key=repr) == sorted(map(tuple, QUERIES["op10_feistel_sharding"](spark, SF).collect()), key=repr)


def test_extraction_keeps_paragraphs(spark):
    rows = QUERIES["op8_min_cut_extraction"](spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) > 0.9 * len(rows)
