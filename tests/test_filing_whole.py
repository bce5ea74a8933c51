"""Segments filed under buckets near the poles, and points that meet their lists."""

import math
import random

import pytest

from tests.oracle import SF
from waymark.operators import roads as R
from waymark.plans.catalog import QUERIES


def largest_explode(plan) -> int:
    """Most rows that an explode of a plan that has run made."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name.startswith("AdaptiveSparkPlan") else plan.plan() if "QueryStage" in name else None
    if inner is not None:
        return largest_explode(inner)
    made = [largest_explode(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([plan.metrics().get("numOutputRows").get().value() if name == "Generate" else 0, *made])


def test_only_asked_buckets_are_made(spark):
    """Near a pole a segment touches up to all 360,000 columns, of which only those with points count."""
    rng = random.Random(8)
    lines = [(i, lat := rng.choice([0.0, 60.0, 89.9, 89.9995, 120.0]), rng.choice([0.0, 75.0, 179.9995, -179.9995]), lat + rng.uniform(-1e-3, 1e-3)) for i in range(40)]
    segments = spark.createDataFrame([(i, a, x, b, x + 1e-4) for i, a, x, b in lines], "edge_id long, lat1 double, lng1 double, lat2 double, lng2 double")
    asked = spark.createDataFrame([(0, 0), (-1, 0), (0, 180_000), (0, 179_999), (60_000, 75_000), (89_900, 5), (89_900, 359_999), (89_999, 80_000), (500, 7)], "_row long, _col long")
    found = R.with_buckets(segments, 0.001, 4.5e-4, asked).select("edge_id", "_row", "_col")
    near = sorted(map(tuple, found.collect()))
    every = R.with_buckets(segments, 0.001, 4.5e-4).join(asked, ["_row", "_col"], "left_semi").select("edge_id", "_row", "_col")
    assert near == sorted(map(tuple, every.collect()))
    assert {r[1] for r in near} >= {0, 89_999}
    assert largest_explode(found._jdf.queryExecution().executedPlan()) < 10_000


@pytest.mark.parametrize("text", [False, True])
def test_lists_like_a_plain_version(spark, text):
    """Many points and segments with ties, of whole and text ids, in several packs of a bucket."""
    rng = random.Random(9)
    metre = math.degrees(1 / 6371000)
    lines = [(i, *(rng.randrange(-60, 60) * 10 * metre for _ in range(4))) for i in range(300)]
    lines += [(1000 + i, *line[1:]) for i, *line in ((j, *x) for j, x in enumerate(lines[:150]))]
    name = str if text else int
    segments = spark.createDataFrame([(name(i), *x) for i, *x in lines], f"edge_id {'string' if text else 'long'}, lat1 double, lng1 double, lat2 double, lng2 double")
    points = [(i, rng.uniform(-500, 500) * metre, rng.uniform(-500, 500) * metre) for i in range(200)]
    odd = [(900, None, 0.0), (901, 0.0, None), (902, math.nan, 0.0)]
    got = {r["k"]: r["near"] for r in R.near_lists(spark.createDataFrame(points + odd, "k long, lat double, lng double"), segments, keys=["k"], radius=50.0, k=4).collect()}
    assert set(got) == {p[0] for p in points + odd} and not any(got[k] for k, _, _ in odd)
    for k, lat, lng in points:
        east = 6371000 * math.pi / 180 * math.cos(math.radians(lat))
        tried = []
        for i, a, b, c, d in lines:
            ax, ay, bx, by = (b - lng) * east, (a - lat) / metre, (d - lng) * east, (c - lat) / metre
            square = (bx - ax) ** 2 + (by - ay) ** 2
            share = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / square)) if square > 1e-12 else 0.0
            metres = math.hypot(ax + share * (bx - ax), ay + share * (by - ay))
            if metres <= 50:
                tried.append((round(metres, 6), name(i)))
        assert [s["edge_id"] for s in got[k]] == [e for _, e in sorted(tried)[:4]]
        assert [s["distance_m"] for s in got[k]] == pytest.approx([m for m, _ in sorted(tried)[:4]], abs=2e-6)


def test_lists_are_made_once_for_many_points(spark):
    """Numpy makes the lists: no function over arrays, which works one value at a time, and not once more for a filter."""
    segments = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1e-4)], "edge_id long, lat1 double, lng1 double, lat2 double, lng2 double")
    plan = R.edge_candidates(spark.createDataFrame([(1, 0.0, 0.0)], "k long, lat double, lng double"), segments, keys=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambdafunction" not in plan


#: Queries whose points look for streets.
LOOKING = ["edge_candidates", "snapped_points", "live_snapped_points", "polyline_candidates", "span_verdicts", "widened_candidates", "live_positions", "spans_written_back"]


@pytest.mark.parametrize("name", LOOKING)
def test_queries_ask_for_buckets(spark, monkeypatch, name):
    """No query files its streets under buckets where no point is."""
    filing, asked = R.with_buckets, []

    def watched(segments, size, margin=0.0, *of):
        asked.append(len(of))
        return filing(segments, size, margin, *of)

    monkeypatch.setattr(R, "with_buckets", watched)
    assert QUERIES[name](spark, SF).count() > 0
    assert asked and all(asked)
