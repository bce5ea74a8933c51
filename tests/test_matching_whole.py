"""Map matching against a plain version: long ways between points, and reversed twins with negative ids."""

import random
from math import inf, log, pi, sqrt

from tests.test_operators import place

from tests import plain_matching as M
from waymark.operators.matching import match

SIDE, METRES = 6, 1000.0


def plain_viterbi(points, candidates, edges, sigma, beta):
    nodes = {n for u, v, _ in edges for n in (u, v)}
    far = {(a, b): 0.0 if a == b else inf for a in nodes for b in nodes}
    for u, v, length in edges:
        far[u, v] = min(far[u, v], length)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    emit = [[-log(sqrt(2 * pi) * sigma) - 0.5 * (c.distance / sigma) ** 2 for c in row] for row in candidates]
    best = [(s, [i]) for i, s in enumerate(emit[0])]
    for t in range(1, len(points)):
        new = []
        for j, b in enumerate(candidates[t]):
            tried = []
            for (s, path), a in zip(best, candidates[t - 1], strict=True):
                route = M.same_edge(a, b) if a.edge == b.edge else None
                route = a.length - a.offset + far[a.end, b.start] + b.offset if route is None else route
                tried.append((s + (-50.0 if route == inf else -log(beta) - abs(route - M.metres(a.lat, a.lng, b.lat, b.lng)) / beta), path))
            s, path = max(tried, key=lambda x: x[0])
            new.append((s + emit[t][j], [*path, j]))
        best = new
    return max(best, key=lambda x: x[0])


def test_like_a_plain_version_without_bound():
    rng = random.Random(3)
    spots = {(r, c): r * SIDE + c for r in range(SIDE) for c in range(SIDE)}
    streets = [((r, c), (r + a, c + b)) for r, c in spots for a, b in ((0, 1), (1, 0)) if (r + a, c + b) in spots and rng.random() < 0.9]
    edges, roads = [], []
    for k, (p, q) in enumerate(streets):
        for number, (u, v) in ((k + 1, (p, q)), (-k - 1, (q, p))):
            edges.append((spots[u], spots[v], METRES))
            roads.append((number, u, v))
    for beta in (5.0, 500.0):
        graph = M.RoadGraph(iter(edges))
        for _ in range(20):
            points, options = [], []
            for _ in range(5):
                x, y = rng.uniform(0, 5000), rng.uniform(0, 5000)
                points.append((*place(x, y), None))
                row = []
                for number, u, v in rng.sample(roads, 5):
                    share = rng.random()
                    at = place(METRES * (u[1] + share * (v[1] - u[1])), METRES * (u[0] + share * (v[0] - u[0])))
                    row.append(M.Candidate(number, spots[u], spots[v], False, METRES, share * METRES, *at, rng.uniform(0, 30)))
                options.append(row)
            path, total = M.viterbi(points, options, graph, sigma=10.0, beta=beta)
            wanted, at = plain_viterbi(points, options, edges, 10.0, beta)
            assert abs(total - wanted) < 1e-6
            assert [c.edge for c in path] == [options[t][i].edge for t, i in enumerate(at)]


def test_unreachable_nodes_and_a_bound():
    graph = M.RoadGraph(iter([(1, 2, 4000.0), (2, 3, 4000.0), (7, 8, 1.0)]))
    assert graph.distances(1, {3, 8, 99}) == {3: 8000.0}
    assert graph.distances(1, {1, 2, 3}, 5000.0) == {1: 0.0, 2: 4000.0}
    assert graph.distances(99, {99, 1}) == {99: 0.0}


def test_reversed_twins_are_roads(spark):
    (a, b), (c, d) = place(0, 0), place(500, 0)
    roads = spark.createDataFrame([(7, 1, 2, a, b, c, d), (-7, 2, 1, c, d, a, b)], "edge_id long, from_node long, to_node long, lat1 double, lng1 double, lat2 double, lng2 double")
    seen = [(1, i + 1, *place(x, y), None) for i, (x, y) in enumerate([(400, 1), (300, -1), (200, 1), (100, 3000)])]
    points = spark.createDataFrame(seen, "session_id long, seq long, lat double, lng double, accuracy_m double")
    found = match(points, roads).orderBy("seq").collect()
    assert [abs(r["edge_id"]) for r in found[:3]] == [7] * 3
    assert found[3]["edge_id"] is None
