"""Routes over the overlay against a search in memory, and the streaming Viterbi pass against a plain one."""

import heapq
import random

import numpy as np
import pytest
from tests import plain_matching as plain
from tests.test_operators import place

from waymark.operators import matching, routes
from waymark.operators.roads import edge_candidates

EDGES = "from_node long, to_node long, length_m double, lat1 double, lng1 double, lat2 double, lng2 double"


def search(edges, source, going_on=float("inf")):
    """Tentative distances of a search that goes on from nodes within `going_on` metres."""
    out = {}
    for u, v, m in edges:
        out.setdefault(u, []).append((v, m))
    found, open_nodes, done = {source: 0.0}, [(0.0, source)], set()
    while open_nodes:
        far, u = heapq.heappop(open_nodes)
        if u in done or far > going_on:
            continue
        done.add(u)
        for v, m in out.get(u, ()):
            if far + m < found.get(v, float("inf")):
                found[v] = far + m
                heapq.heappush(open_nodes, (far + m, v))
    return found


@pytest.fixture(scope="module")
def town(spark):
    rng, side = random.Random(2), 9
    at = {r * side + c: (10 + r * 0.004 + rng.random() * 0.001, 20 + c * 0.004) for r in range(side) for c in range(side)}
    edges = []
    for node in list(at):
        for ahead in ([node + 1] if (node + 1) % side else []) + [node + side]:
            if ahead in at and rng.random() < 0.8:
                m = 400 + rng.random() * 500
                edges.append((node, ahead, m))
                if rng.random() < 0.7:
                    edges.append((ahead, node, m))
    at |= {1000: (0.0, 0.0), 1001: (0.0, 0.001)}
    edges += [(1000, 1001, 50.0), (1001, 1000, 60.0), (1000, 1001, 70.0)]
    pairs = [(rng.choice(list(at)), rng.choice(list(at))) for _ in range(150)] + [(5, 5), (9999, 9999), (9999, 3), (1000, 3), (1000, 1001), (None, 3), (5, 5)]
    frame = spark.createDataFrame([(u, v, m, *at[u], *at[v]) for u, v, m in edges], EDGES)
    return edges, pairs, frame, spark.createDataFrame(pairs, "source long, target long")


@pytest.mark.parametrize("options", [{"nodes_of_cell": 12}, {"most": 2500.0, "nodes_of_cell": 9}, {}])
def test_shortest_routes(town, options):
    edges, pairs, frame, asked = town
    found = {(r["source"], r["target"]): r["metres"] for r in routes.shortest(frame, asked, **options).collect()}
    wanted = {}
    for a, b in pairs:
        far = 0.0 if a == b else search(edges, a).get(b)
        if a is not None and far is not None and far <= options.get("most", far):
            wanted[a, b] = far
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)


def test_bounded_routes_keep_tentative_distances(town):
    edges, pairs, frame, asked = town
    leaving, beyond = {u for u, _, _ in edges}, 0
    rows = routes.bounded_routes(frame, asked, most=2000.0).collect()
    assert len(rows) == len(pairs)
    for row in rows:
        a, b = row["source"], row["target"]
        far = None if a is None else 0.0 if a == b else search(edges, a, 2000.0).get(b) if a in leaving and b in leaving else None
        assert (row["metres"] is None) == (far is None) and (far is None or abs(far - row["metres"]) < 1e-6)
        beyond += far is not None and far > 2000
    assert beyond


def test_no_edges_and_no_pairs(spark, town):
    _, _, frame, asked = town
    assert routes.shortest(frame.where("false"), asked).count() == 2
    assert routes.shortest(frame, asked.where("false")).count() == 0


def test_full_squares_are_quartered(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, 10 + rng.random() ** 4 * 0.02, 20 + rng.random() ** 4 * 0.02) for i in range(500)] + [(1000 + i, 5.0, 5.0) for i in range(30)], "node_id long, lat double, lng double")
    cells = routes.cells_of(nodes, most=20)
    assert cells.count() == 530
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    assert sorted(sizes.values())[-2] <= 20 and max(sizes.values()) == 30  # one place cannot be quartered


@pytest.mark.parametrize("look", [2, 64])
def test_streamed_viterbi(spark, monkeypatch, look):
    monkeypatch.setattr(matching.Survivors, "__init__", lambda self, first: self.__dict__.update(rows=[(first, None)], look=look))
    rng = np.random.default_rng(look)
    rows, wanted = [], {}
    for session, n in ((1, 1), (2, 300), (3, 40), (None, 5)):
        scores, back = None, []
        for seq in range(1, n + 1):
            here = np.round(rng.normal(size=rng.integers(1, 5)), 1)
            moves = None if scores is None else np.round(rng.normal(size=(len(scores), len(here))) * 0.3, 1) * (rng.random() < 0.9)
            rows.append((session, seq, here.tolist(), None if moves is None else moves.ravel().tolist()))
            if scores is not None:
                back.append(np.argmax(scores[:, None] + moves, axis=0))
                scores = (scores[:, None] + moves).max(axis=0) + here
            else:
                scores = here
        path = [int(np.argmax(scores))]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        wanted[session] = (path[::-1], float(scores.max()), n)
    found = matching.viterbi(spark.createDataFrame(rows, "session_id long, seq long, emissions array<double>, moves array<double>")).collect()
    for session, (path, total, n) in wanted.items():
        mine = sorted((r["seq"], r["choice"]) for r in found if r["session_id"] == session and r["seq"] is not None)
        assert mine == [(i + 1, c) for i, c in enumerate(path)]
        last = [r for r in found if r["session_id"] == session and r["seq"] is None]
        assert len(last) == 1 and abs(last[0]["total"] - total) < 1e-9 and last[0]["n"] == n


def test_matched_like_a_plain_matcher(spark):
    rng, side = random.Random(8), 5
    spots = {(r, c): r * side + c for r in range(side) for c in range(side)}
    streets = [(p, q) for p in spots for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in spots and rng.random() < 0.85]
    roads = []
    for k, (p, q) in enumerate(streets):
        for number, (u, v) in ((k + 1, (p, q)), (-k - 1, (q, p))):
            if number > 0 or k % 3:
                roads.append((number, spots[u], spots[v], *place(120 * u[1], 120 * u[0]), *place(120 * v[1], 120 * v[0]), k % 3 == 0))
    edges = spark.createDataFrame(roads, "edge_id long, from_node long, to_node long, lat1 double, lng1 double, lat2 double, lng2 double, oneway boolean")
    seen = [(s, i + 1, *place(rng.uniform(-30, 520), rng.uniform(-30, 520)), rng.choice([None, 3.0, 40.0])) for s in (1, 2) for i in range(25)]
    seen[5] = (*seen[4][:1], 6, *seen[4][2:4], None)
    points = spark.createDataFrame(seen, "session_id long, seq long, lat double, lng double, accuracy_m double")
    found = {(r["session_id"], r["seq"]): r for r in matching.match(points, edges).collect()}
    graph = plain.RoadGraph((u, v, plain.metres(a, b, c, d)) for _, u, v, a, b, c, d, _ in roads)
    options = {}
    for r in edge_candidates(points, edges, keys=["session_id", "seq"]).orderBy("rank").collect():
        options.setdefault((r["session_id"], r["seq"]), []).append(plain.Candidate(r["edge_id"], r["from_node"], r["to_node"], r["oneway"], r["length_m"], r["offset_m"], r["proj_lat"], r["proj_lng"], r["distance_m"]))
    for session in (1, 2):
        mine = [x for x in seen if x[0] == session]
        rows = [options.get(x[:2]) or [plain.Candidate(None, None, None, True, 0.0, 0.0, x[2], x[3], 0.0)] for x in mine]
        path, total = plain.viterbi([x[2:] for x in mine], rows, graph, sigma=4.07, beta=5.0)
        got = [found[x[:2]] for x in mine]
        # a street and its twin are equally likely but for the last bits of sums of lengths
        assert [abs(r["edge_id"] or 0) for r in got] == [abs(c.edge or 0) for c in path]
        assert all(abs(r["matched_lat"] - c.lat) < 1e-12 for r, c in zip(got, path, strict=True))
        assert all(abs(r["confidence"] - min(1.0, np.exp(total / len(path) / 10))) < 1e-9 for r in got)


@pytest.mark.parametrize("shortcut", [None, 2.0])
def test_bounded_search_deals_only_what_is_near_to_cells(spark, monkeypatch, shortcut):
    """A road of 2000 nodes across the 180th meridian, 28 m a step; with a shortcut to its far end nothing can be left out."""
    at = {n: (60.0 + n % 2 * 1e-5, (179.99 + n * 5e-4 + 180) % 360 - 180) for n in range(2000)}
    edges = [(n, n + 1, 28.5) for n in range(1999)] + [(n + 1, n, 28.5) for n in range(1999)]
    edges += [(10, 1990, shortcut)] if shortcut else []
    frame = spark.createDataFrame([(u, v, m, *at[u], *at[v]) for u, v, m in edges], EDGES)
    pairs = [(5, 60), (30, 9), (12, 100), (3, 1985), (3, 5000), (70, 70)]
    dealt, whole = [], routes.cells_of
    monkeypatch.setattr(routes, "cells_of", lambda nodes, *a: dealt.append(nodes.count()) or whole(nodes, *a))
    rows = routes.bounded_routes(frame, spark.createDataFrame(pairs, "source long, target long"), most=1000.0).collect()
    assert {(r["source"], r["target"]) for r in rows} == set(pairs)
    for r in rows:
        far = search(edges, r["source"], 1000.0).get(r["target"])
        assert (r["metres"] is None) == (far is None) and (far is None or abs(far - r["metres"]) < 1e-6)
    assert sum(r["metres"] is not None for r in rows) == 2 + bool(shortcut)
    assert dealt[0] == 2000 if shortcut else dealt[0] < 250
