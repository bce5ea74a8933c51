"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; rare paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import language_id, near_dedup, sharding, substring_dedup
from waymark.llm.decontamination import contamination, drop_contaminated, remove_spans
from waymark.llm.html_extract import extract, main_text, max_flow_labels, minimum_cut
from waymark.llm.language_id import drop_unidentified, identify
from waymark.llm.lm_scoring import score_documents
from waymark.llm.packing import pack
from waymark.llm.queries import QUERIES
from waymark.llm.topk_search import exact_topk
from waymark.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, symbol int, node int"


def docs(spark, texts):
    rows = [(i, t, "en", None, None, "k", "k", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t"), (4, "word"), (4, "word"), (None, "lost id"), (5, "é " * 3000), (6, "a" * 200_000), (7, "one two three four five six")]


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(request, spark):
    return docs(spark, ODD if request.param == "odd" else [])


def test_every_document_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, None), (2, "word"), (None, "x")], "item_id long, text string")
    assert pack(odd).select("doc_id").count() >= n
    assert substring_dedup.dedup_digest(odd).count() == n
    assert score_documents(odd, F.col("doc_id") > 2).count() == n
    assert contamination(odd, bench).count() == n
    assert identify(odd).count() == n
    assert near_dedup.near_duplicates(odd).count() == n
    assert sharding.shard_documents(odd).count() == n
    kept = drop_contaminated(substring_dedup.remove_repeats(near_dedup.drop_near_duplicates(drop_unidentified(odd)), count_col="n_chars"), bench)
    assert kept.columns == odd.columns
    assert remove_spans(odd, bench).count() == n


def test_values_of_odd_rows(spark):
    rows = docs(spark, ODD)
    near = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(rows, size=3).collect()}
    assert near[(1, 0)]["component_id"] == 1
    assert near[(4, 1)]["kept"]
    assert near[(None, 1)]["component_id"] is None
    assert {r["lang_pred"] for r in identify(rows).where("doc_id IN (1, 2, 3)").collect()} == {"und"}


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for p in places.values():
        if len(p) > 1:
            for d, i in p:
                gone[d].update(range(i, i + window))
    return [len(g) for g in gone]


@pytest.mark.parametrize(("together", "length"), [(1, 60), (2000, 60), (1, 700), (2000, 700)])
def test_repeats_like_brute_force(spark, monkeypatch, together, length):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    rng = random.Random(together)
    passage = [rng.choice("abcdefgh") for _ in range(length)]
    texts = []
    for _ in range(40):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.5:
            at, size = rng.randint(0, len(words)), rng.randint(20, length)
            start = rng.randint(0, length - size)
            words[at:at] = passage[start : start + size]
        texts.append(" ".join(words))
    texts += ["x " * 100, "x " * 40, texts[0], "ab " * 35, "q " + "a b " * 90 + "r", "a b " * 70 + "s", "t " + "b a " * 18, "one two three four five " * 30 + "end", "x one two three four five " * 9]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_digest(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


@pytest.mark.parametrize(("small", "heavy", "copies"), [(32, 100_000, 8), (2, 100_000, 24), (2, 20, 24)])
def test_near_duplicates_like_brute_force(spark, monkeypatch, small, heavy, copies):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    rng = random.Random(5)
    texts = []
    for _ in range(72 // copies):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(80)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(80)] = "changed%d" % rng.randrange(3 if rng.random() < 0.5 else 10**6)
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    of = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, list(enumerate(texts))), size=3, percent=85, bands=24).collect()}
    assert [got[i] for i in range(len(texts))] == of


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    both = near_dedup.super_minhash([np.concatenate([common, own[0]]), np.concatenate([common, own[1]])], 256)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.12


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_the_shuffle_is_one_to_one(spark, n):
    places = [r[0] for r in spark.range(n).select(sharding.permuted("id", n, 3)).collect()]
    assert sorted(places) == list(range(n))
    assert n < 100 or places != list(range(n))


def test_topk_with_ties_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (100, [0.5, 0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk(vectors, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20), (100, 1, 1, 768 << 10), (100, 2, 0, 512 << 10)]


def test_urls(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("org", "block")]
    urls = [None, "no scheme", "http://A.example.com/en/7?q", "https://x.com/en/", "x://xcom/en/", "x://y.org#z", "x://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("x.com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"), ("y.org", "", "org", "block"), ("", "", None, "allow")]


def test_pages(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>First   paragraph with\nsome words in it.</p><p>Second one, also long enough to be read.</p></article><div class='comments'><p>Nice post, thanks a lot for writing it!</p></div><footer>All rights reserved</footer></body></html>"
    assert main_text(page) == "Title & more\n\nFirst paragraph with some words in it.\n\nSecond one, also long enough to be read."
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (3, "u", "<p", 1), (4, "u", "<div>" * 3000 + "x", 1)], "page_id long, url string, html string, text int")
    assert extract(pages).count() == 4


def test_cuts_are_minimal():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 7)
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(labels):
            return sum(abs(g) for g, x in zip(gains, labels, strict=True) if x != (g > 0)) + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(gains, edges)) == pytest.approx(best, abs=1e-6)
        assert cost(max_flow_labels(gains, edges)) == pytest.approx(best, abs=1e-6)


def test_one_row_of_each_component_stays(spark):
    def text(seed, n=60):
        rng = random.Random(seed)
        return " ".join("%08x" % rng.getrandbits(32) for _ in range(n))

    twice, lost, low, clash, alone = map(text, range(5))
    rows = docs(spark, [(1, twice), (1, twice), (None, lost), (None, lost.upper()), (2, low), (5, low), (5, clash), (None, alone), (9, None), (9, " ")])
    kept = near_dedup.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower().strip()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, twice), (None, lost), (2, low), (5, clash), (None, alone), (9, ""), (9, "")], key=repr)
    unharmed = {(r["text"] or "").lower().strip() for r in substring_dedup.remove_repeats(kept, count_col="n_chars").collect()}
    assert unharmed == {twice, lost, low, clash, alone, ""}


def test_topk_keeps_large_components(spark):
    big, huge = 2.0**21, 2.0**70
    rows = [(0, [1.0, 0.0, 0.0]), (1, [big, 1.0, 0.0]), (2, [-big, 5.0, 0.0]), (3, [1.0, huge, 0.0]), (100, [big, -3.0, 2.0**40]), (4, [0.5, 2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in exact_topk(vectors.where("vec_id <> 3"), F.col("vec_id") % 100 == 0, k=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = {i: [int(x * 1024) for x in v] for i, v in rows if i != 3}
    for q in (0, 100):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    alone = exact_topk(vectors, F.col("vec_id") == 0, k=9).where("vec_id = 3").first()
    assert (alone["rank"], alone["score"]) == (3, 1 << 20)
    with pytest.raises(Exception, match="does not fit in a long"):
        exact_topk(vectors, F.col("vec_id") == 100, k=9).collect()


def test_exact_scores_like_whole_numbers():
    from waymark.llm.topk_search import exact_scores

    rng = random.Random(4)
    a, b = ([[float(rng.choice([0, rng.randint(-9, 9), rng.randint(-9, 9) * 2 ** rng.randint(0, 62)])) for _ in range(3)] for _ in range(30)] for _ in "ab")

    def terms(lines):
        found = [(i, t, x) for t in range(3) for i, line in enumerate(lines) if (x := line[t])]
        return tuple(np.array(c) for c in zip(*found, strict=True))

    true = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    fits = np.array([[abs(s) < 2**63 for s in line] for line in true])
    got = exact_scores(30, 30, terms(a), terms(b), fits)
    assert fits.any() and not fits.all()
    assert all(got[i, j] == true[i][j] for i, j in zip(*np.nonzero(fits), strict=True))


def test_values_of_clashing_columns_stay(spark):
    rng = random.Random(8)
    passage = " ".join("%06x" % rng.getrandbits(24) for _ in range(50))
    texts = [f"{' '.join('%06x' % rng.getrandbits(24) for _ in range(60))} {passage}" for _ in range(3)]
    names = ["_key", "_text", "_letters", "_lang", "_score", "_text_key", "_winner", "_TEXT_", "node", "label"]
    rows = spark.createDataFrame([(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)], ", ".join(["doc_id long, text string, lang string", *(f"{n} string" for n in names)]))
    expected = {i: [f"{n}{i}" for n in names] for i in range(3)}
    for apply in (substring_dedup.remove_repeats, near_dedup.drop_near_duplicates, drop_unidentified):
        got = apply(rows)
        assert got.columns == rows.columns
        assert {r["doc_id"]: [r[n] for n in names] for r in got.collect()} == expected


def test_unsure_languages_leave(spark):
    rng = random.Random(3)
    words = {"en": ["the", "that", "with", "which"], "fr": ["où", "être", "façade", "mélange"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [(1000 + i, text, None) for i, text in enumerate(["0x0 9", "qzj", "the which that", None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(table).collect()}
    for least, languages in ((0.5, None), (0.9, None), (0.5, ["en"])):
        kept = {r["doc_id"] for r in drop_unidentified(table, least=least, languages=languages).collect()}
        assert kept == {i for i, (lang, score) in scores.items() if lang != "und" and score > least and (languages is None or lang in languages)}
    bar = sorted(s for _, s in scores.values() if s > 0)[1]
    assert {i for i, (_, s) in scores.items() if s > bar} == {r["doc_id"] for r in drop_unidentified(table, least=bar).collect()}


def test_network_like_plain_convolution():
    net = language_id.train(["the that which", "où être façade"], ["en", "fr"], steps=3)
    text = "The façade, " * 40
    raw = text.encode()
    total, weight = np.zeros(2), 0
    for at in range(0, len(raw), 256):
        part = np.frombuffer(raw[at : at + 256].ljust(256, b"\0"), dtype=np.uint8)
        vectors = net.embed[part]
        pooled = [np.max([vectors[i : i + w].ravel() @ f + b for i in range(257 - w)], axis=0) for w, f, b in zip(language_id.WIDTHS, net.filters, net.biases, strict=True)]
        line = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
        size = min(256, len(raw) - at)
        total += size * (line - np.log(np.exp(line).sum()))
        weight += size
    plain = np.exp(total / weight)
    (lang,), (score,) = language_id.Scorer(net).texts([text])
    assert score == pytest.approx((plain / plain.sum()).max(), abs=1e-4)
    assert lang == net.languages[int(plain.argmax())]


@pytest.mark.parametrize("name", ["_size", "shard", "Slot"])
def test_reserved_names_are_refused(spark, name):
    with pytest.raises(ValueError, match="reserved"):
        sharding.shard_rows(spark.range(3).withColumn(name, F.lit(1)), 2, ["id"])


def test_sample_of_a_huge_language_is_not_empty():
    assert language_id.bar_of(10, 300) == 1 << 62
    assert all(abs(language_id.bar_of(n, 300) / 2**62 * n - 900) < 1e-3 for n in (10**6, 10**9, 10**13))


def test_url_rules_are_the_contract_s(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://a.example.net/de/80", "http://a.org/es/1", "http://a.org/fr/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r["rule"], r["verdict"]) for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
