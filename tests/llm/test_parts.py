"""Test items in several automata give what one gives."""

import pytest
from tests.oracle import SF, connect, of_frame, of_sql

from waymark.llm import decontamination as D
from waymark.llm.queries import ORACLES, QUERIES


def test_parts_like_sql(spark, monkeypatch):
    one = sum(len(t or "") for (t,) in connect().sql("SELECT text FROM benchmark").fetchall())
    monkeypatch.setattr(D, "PART_BYTES", one // 3)
    items = [(str(i), t) for i, t in connect().sql("SELECT item_id, text FROM benchmark WHERE text IS NOT NULL").fetchall()]
    assert len(list(D.parts_of(items, 13, D.PART_BYTES))) > 2
    assert of_frame(QUERIES["op5_decontamination"](spark, SF)) == of_sql(connect(), ORACLES["op5_decontamination"])


@pytest.mark.parametrize("most", [1, 40, 200, 10_000])
def test_a_long_item_keeps_every_window(most):
    words = [b"w%d" % (i % 37) for i in range(400)]
    pieces = [p for part in D.parts_of([("a", b" ".join(words).decode()), ("b", "x y"), ("c", "")], 13, most) for item, p in part if item == "a"]
    assert {tuple(p[i : i + 13]) for p in pieces for i in range(len(p) - 12)} == {tuple(words[i : i + 13]) for i in range(388)}
    assert all(len(p) >= 13 for p in pieces)


def test_no_items_and_clashing_names(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d", b"h", "i"), (2, None, None, None), (3, "", b"", ""), (4, "q r s t u v w x y z " * 3, b"h", "i")], "doc_id long, text string, _hits binary, _items string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert D.drop_contaminated(docs, none).count() == 4
    items = spark.createDataFrame([("p", "c d"), ("q", "A b"), ("r", None), (None, "q r"), ("s", "")], "item_id string, text string")
    monkeypatch.setattr(D, "PART_BYTES", 3)
    assert sorted(map(tuple, D.drop_contaminated(docs, items).collect()), key=str) == sorted((tuple(r) for r in docs.where("doc_id > 1").collect()), key=str)
    assert [r["text"].strip() if r["text"] else r["text"] for r in D.remove_spans(docs, items).orderBy("doc_id").where("doc_id < 4").collect()] == ["", None, ""]
