"""Snapping by heading and speed."""

import math

import pytest

from waymark.operators import roads as R

METRE = math.degrees(1 / 6371000)


def test_snapping_by_heading(spark):
    def line(i, x1, y1, x2, y2, oneway=False):
        return (i, y1 * METRE, x1 * METRE, y2 * METRE, x2 * METRE, oneway)

    lines = [line(1, -50, 0, 50, 0), line(2, 5, -50, 5, 50, True)] + [line(100 + i, -50, 1, 50, 1) for i in range(80)]
    segments = spark.createDataFrame(lines, "edge_id long, lat1 double, lng1 double, lat2 double, lng2 double, oneway boolean")
    # at the origin: a road to the east below, 80 more a metre off, and a one-way street to the north five metres off
    asked = [(1, 90.0, 9.0), (2, 0.0, 9.0), (3, 180.0, 9.0), (4, 180.0, 0.5), (5, 270.0, 9.0), (6, None, 9.0), (7, 44.0, 9.0), (8, 46.0, 9.0)]
    points = spark.createDataFrame([(k, 0.0, 0.0, h, v) for k, h, v in asked], "k long, lat double, lng double, course double, v double")
    rows = {r["k"]: r for r in R.snapped(points, segments, keys=["k"], heading="course", speed="v").collect()}
    assert {k: r["edge_id"] for k, r in rows.items()} == {1: 1, 2: 2, 3: None, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1}
    assert (rows[1]["confidence"], rows[3]["confidence"]) == (pytest.approx(1.0), 0.0)
    assert rows[2]["confidence"] == pytest.approx(0.75, abs=0.01)


def test_pairs_are_not_dealt_out_again(spark):
    """Lists of a bucket's segments meet the points: no window or sort over pairs, and packs of one bucket are brought together."""
    lines = [(i, 0.0, 0.0, (10 + i) * METRE, 40 * METRE) for i in range(400)]
    segments = spark.createDataFrame(lines, "edge_id long, lat1 double, lng1 double, lat2 double, lng2 double")
    points = spark.createDataFrame([(1, 5 * METRE, 5 * METRE), (2, 30 * METRE, 1 * METRE), (3, 1.0, 1.0), (4, None, 1.0)], "k long, lat double, lng double")
    found = R.edge_candidates(points, segments, keys=["k"])
    got = {}
    for r in found.collect():
        got.setdefault(r["k"], {})[r["rank"]] = (round(r["distance_m"], 6), r["edge_id"])
    within = R.segments_within(points, segments, 50.0, 0.001).collect()
    assert set(got) == {1, 2}
    for k, ranks in got.items():
        assert [ranks[i + 1] for i in range(5)] == sorted((round(r["distance_m"], 6), r["edge_id"]) for r in within if r["k"] == k)[:5]
    assert "Window" not in found._jdf.queryExecution().toString()
