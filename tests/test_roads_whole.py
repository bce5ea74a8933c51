"""Nearest nodes at any distance."""

import math
import random

import pytest

from waymark.operators import roads as R


def test_nearest_nodes_at_any_distance(spark):
    rng = random.Random(6)
    nodes = [(i, rng.gauss(10, 0.05), rng.gauss(20, 0.05)) for i in range(150)] + [(200 + i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(20)]
    nodes += [(500, 0.0, 179.0), (499, 0.0, 179.0)]
    points = [(i, rng.gauss(10, 0.2), rng.gauss(20, 0.2)) for i in range(60)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    points += [(300, 10.0, 24.0), (301, 0.0, 180.0)]
    odd = [(400, None, 1.0), (401, math.nan, 1.0)]
    found = R.nearest_nodes(spark.createDataFrame(points + odd, "k long, lat double, lng double"), spark.createDataFrame(nodes, "node_id long, lat double, lng double"), keys=["k"])
    got = {r["k"]: (r["node_id"], r["degrees"]) for r in found.collect()}
    assert set(got) == {k for k, _, _ in points}
    for k, lat, lng in points:
        degrees, node = min((math.hypot(lat - a, lng - b), n) for n, a, b in nodes)
        assert got[k] == (node, pytest.approx(degrees, abs=1e-12))
    assert got[301][0] == 499


def test_no_nodes_give_none(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0)], "k long, lat double, lng double")
    assert R.nearest_nodes(points, spark.createDataFrame([], "node_id long, lat double, lng double"), keys=["k"]).count() == 0


def test_crowded_nodes_and_points_that_stay(spark, monkeypatch):
    """Nodes of one bucket beyond a pack, and points that are not dealt out, cut and taken off by a join."""

    def not_here(df):
        raise AssertionError("points with a node near by are settled where they are")

    monkeypatch.setattr(R, "cut", not_here)
    rng = random.Random(7)
    nodes = [(i, rng.uniform(0.0, 0.002), rng.uniform(0.0, 0.002)) for i in range(600)]
    points = [(i, rng.uniform(0.0, 0.002), rng.uniform(0.0, 0.002)) for i in range(40)]
    found = R.nearest_nodes(spark.createDataFrame(points, "k long, lat double, lng double"), spark.createDataFrame(nodes, "node_id long, lat double, lng double"), keys=["k"])
    got = {r["k"]: r["node_id"] for r in found.collect()}
    assert got == {k: min((math.hypot(lat - a, lng - b), n) for n, a, b in nodes)[1] for k, lat, lng in points}
