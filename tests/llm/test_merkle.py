"""The Merkle manifest against a plain tree in memory."""

import zlib
from hashlib import sha256

import pytest

from waymark.llm.merkle import build, manifest_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, hash string, _tampered string, tree int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def folded(nodes):
    """(top, for each node its siblings on every level and its slots there) of a tree over `nodes`."""
    paths = [[] for _ in nodes]
    of = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in of[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            above.append(h("".join(run)))
            members.append([i for k in range(len(run)) for i in of[a + k]])
        nodes, of = above, members
    return nodes[0], paths


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: folded([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = folded([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, tops, strict=True):
        for (_, _, own, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            now = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                now = leaf(row | {"text": row["text"] and row["text"].translate(low)})
            siblings = ""
            for left, right in path + up:
                siblings += "".join(left + right)
                now = h("".join([*left, now, *right]))
            out.append((row["doc_id"], own, trees[s][0], root, h(siblings), now, now == root))
    return sorted(out, key=repr)


def rows_of(n, sources):
    made = [{"doc_id": i * 7 % n, "text": f"Text {i} é" * (i % 3), "lang": None if i % 4 == 0 else "en", "source": sources[i % len(sources)], "n_chars": i} for i in range(n)]
    odd = [{"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 3, "text": "", "lang": "", "source": "", "n_chars": 0}]
    return made + odd + odd + made[:2]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (40, ["a"]), (300, ["a", "b", None, "é", "Z"]), (70, [str(i) for i in range(35)])])
def test_same_as_a_tree_in_memory(spark, n, sources):
    rows = rows_of(n, sources)
    df = spark.createDataFrame([tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) + ("x", "y", "z", 1) for r in rows], SCHEMA)
    found = sorted([tuple(r) for r in manifest_digest(df).select(*COLUMNS).collect()], key=repr)
    assert found == plain(rows)


def test_one_row_is_its_own_root_and_none_gives_none(spark):
    row = {"doc_id": 4, "text": "A", "lang": None, "source": None, "n_chars": 1}
    df = spark.createDataFrame([(4, "A", None, None, 1, "x", "y", "z", 1)], SCHEMA)
    assert [tuple(r) for r in manifest_digest(df).select(*COLUMNS).collect()] == plain([row])
    assert manifest_digest(df.where("doc_id = 5")).count() == 0


def test_inner_nodes_hash_their_preimages(spark):
    leaves = spark.range(300).selectExpr("CAST(id % 3 AS STRING) AS source", "id div 3 AS place", "CAST(100 AS BIGINT) AS size", "sha2(CAST(id AS STRING), 256) AS hash")
    manifest = build(leaves)
    nodes = manifest.nodes().collect()
    assert len(nodes) == 3 * (7 + 1) + 1
    assert all(n["hash"] == h(n["preimage"]) and len(n["preimage"]) <= 1024 for n in nodes)
    assert manifest.root in {n["hash"] for n in nodes}
