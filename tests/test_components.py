"""Components by contraction against a plain union of sets, and how many rows the rounds write."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import roads


def plain(edges):
    """The smallest node reachable from each node; an edge with a null end is a loop."""
    least = {}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = (b if a is None else a), (a if b is None else b)
        if a is not None:
            for x in (a, b):
                least.setdefault(x, x)
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return {x: root(x) for x in least}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_of_any_graph(spark, kind):
    rng = random.Random(3)
    ids = [(lambda n: f"n{n}") if kind == "string" else (lambda n: n)][0]
    chain = rng.sample(range(1000, 1400), 400)
    edges = list(zip(chain, chain[1:]))[:250] + [(5000, n) for n in range(5001, 5050)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = [(ids(a), ids(b)) for a, b in edges] * 2 + [(ids(-7), None), (None, ids(-8)), (None, None), (ids(-9), ids(-9)), (None, ids(5))]
    found = roads.components(spark.createDataFrame(edges, f"from_node {kind}, to_node {kind}")).collect()
    assert len(found) == len({r["node_id"] for r in found})
    assert {r["node_id"]: r["component"] for r in found} == plain(edges)


def test_no_edges_have_no_components(spark):
    assert roads.components(spark.createDataFrame([], "from_node long, to_node long")).collect() == []


def test_rounds_shrink_along_a_chain(spark, monkeypatch):
    """A chain in order, as a column of the lattice is: all rounds together write a few times its rows."""
    rows = []

    def counted(whole):
        return lambda df: (made := whole(df), rows.append(made.count()))[0]

    for name in ("cut", "written"):
        monkeypatch.setattr(roads, name, counted(getattr(roads, name)))
    found = roads.components(spark.range(4000).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node")))
    assert found.where("component = 0").count() == found.count() == 4001
    assert sum(rows) < 8 * 4000
