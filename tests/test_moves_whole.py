"""Unbounded searches that look at what is near first, and moves that are no rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import moves as N
from waymark.operators import routes as V

METRE = math.degrees(1 / 6371000)


def test_unbounded_searches_look_near_first(spark, monkeypatch):
    """A chain of 40 km: near pairs need no far edges, far ones get their answer later."""
    line = [(i, i + 1, 1000.0, 0.0, i * 1000 * METRE, 0.0, (i + 1) * 1000 * METRE) for i in range(40)]
    edges = spark.createDataFrame(line, "from_node long, to_node long, length_m double, lat1 double, lng1 double, lat2 double, lng2 double")
    seen = []

    def along_the_chain(near, pairs, most, *rest):
        seen.append((near.count(), most))
        metres = pairs.withColumn("metres", (F.col("target") - F.col("source")) * 1000.0)
        return metres.where(F.col("metres").between(0.0, most or 1e9))

    monkeypatch.setattr(V, "_searched", along_the_chain)

    def answers(*asked):
        seen.clear()
        return {(r["source"], r["target"]): r["metres"] for r in V.shortest(edges, spark.createDataFrame(asked, "source long, target long")).collect()}

    assert answers((3, 5), (7, 7)) == {(3, 5): pytest.approx(2000.0), (7, 7): 0.0}
    assert len(seen) == 1 and seen[0][0] < 30
    assert answers((10, 30), (5, 3)) == {(10, 30): pytest.approx(20_000.0)}
    assert seen[-1] == (40, None)


def test_moves_are_arrays_of_a_row(spark):
    """Same edge, another one, off the roads, and no route; pairs are asked for once, and no move is a row."""
    kind = "array<struct<edge_id: long, from_node: long, to_node: long, oneway: boolean, length_m: double, offset_m: double, proj_lat: double, proj_lng: double>>"
    one, two, off = (1, 10, 11, True, 100.0, 60.0, 0.0, 0.0), (2, 11, 12, False, 100.0, 30.0, 0.0, 0.0), (None, None, None, True, 0.0, 0.0, 0.0, 0.0)
    back = (1, 10, 11, True, 100.0, 50.0, 0.0, 0.0)
    rows = spark.createDataFrame([(s, 1, [one, two]) for s in range(50)] + [(s, 2, [two, back, off]) for s in range(50)], f"session_id long, seq long, options {kind}")
    asked = []

    def lengths(pairs):
        asked.extend(tuple(r) for r in pairs.collect())
        return spark.createDataFrame([(11, 11, 0.0)], "source long, target long, metres double")

    def weigh(route, straight, same, of):
        return np.where(np.isnan(route), -1.0, route) + of["k"] + straight

    steps = N.weighed(rows, lengths, weigh, emissions=F.array(F.lit(0.0)), numbers_of={"k": F.col("seq") * 1000}, lagged=["seq"], radius=6371000.0, backward_m=25.0, backward_factor=1.5, two_way=True, same_edge=True)
    got = {(r["session_id"], r["seq"]): r["moves"] for r in steps.collect()}
    # from edge 1: on to edge 2 by its end, back on its own, off the roads; from edge 2: stays, by node 12 to 10, off
    assert len(got) == 100 and all(got[s, 2] == [2070.0, 2015.0, 1999.0, 2000.0, 1999.0, 1999.0] and not got[s, 1] for s in range(50))
    assert sorted(asked) == [(11, 11), (12, 10)]
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
