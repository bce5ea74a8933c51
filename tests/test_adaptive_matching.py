"""The exporter's matcher against a plain one over lists, and its parts."""

import random
from math import cos, hypot, inf, log, pi, radians, sqrt

from tests import plain_matching as plain
from tests.test_operators import place
from tests.test_routes import search

from waymark.operators import adaptive_matching as A
from waymark.operators.roads import METRES_A_DEGREE

ROWS = "session_id long, seq long, t_ms long, lat double, lng double, speed_kmh double, accuracy_m double, is_dr boolean"
EDGES = "edge_id long, from_node long, to_node long, oneway boolean, points array<struct<lat:double,lng:double>>"


def onto(lat, lng, points):
    """(distance, offset, lat, lng) of the nearest place on a line."""
    east, before, best = METRES_A_DEGREE * cos(radians(lat)), 0.0, (inf,)
    for (la, na), (lb, nb) in zip(points, points[1:], strict=False):
        ax, ay, bx, by = (na - lng) * east, (la - lat) * METRES_A_DEGREE, (nb - lng) * east, (lb - lat) * METRES_A_DEGREE
        u = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        far = hypot(ax + u * (bx - ax), ay + u * (by - ay))
        if far < best[0] - 1e-6:
            best = (far, before + u * hypot(bx - ax, by - ay), la + u * (lb - la), na + u * (nb - na))
        before += plain.metres(la, na, lb, nb)
    return best


def plain_match(rows, edges):
    roads = {}
    for name, u, v, oneway, points in edges:
        length = sum(plain.metres(*a, *b) for a, b in zip(points, points[1:], strict=False))
        roads[str(name)] = (u, v, points, length)
        if not oneway:
            roads[f"{name}_rev"] = (v, u, points[::-1], length)
    graph = [(u, v, length) for u, v, _, length in roads.values()]
    leaving = {u for u, _, _ in graph}
    kept, group = [], []
    for i, (t, lat, lng, speed, accuracy, dr) in enumerate(rows):
        group.append(i)
        after = rows[i + 1] if i + 1 < len(rows) else None
        if not (dr and speed < 1 and after is not None and after[5] and after[3] < 1):
            kept.append((t, lat, lng, speed, accuracy, dr, group))
            group = []

    def sigma(accuracy, dr, step):
        if dr:
            return max(6.0, min(20.0, max(accuracy if accuracy and accuracy > 0 else 10.0, 8 + min(8.0, 0.4 * step))))
        return max(2.0, min(accuracy, 8.0)) if accuracy and accuracy > 1 else 4.07

    options, weights, steps, drift = [], [], [], 0
    for n, (_, lat, lng, _, accuracy, dr, _) in enumerate(kept):
        drift = drift + 1 if dr else 0
        counted = drift - 1 if all(k[5] for k in kept[: n + 1]) else drift
        weights.append(sigma(accuracy, dr, counted))
        every = sorted((round(x[0], 6), name, x) for name, road in roads.items() for x in [onto(lat, lng, road[2])])
        wide = [(name, x) for far, name, x in every if x[0] <= 80][:8]
        near = [(name, x) for name, x in wide if x[0] <= min(60.0, max(30.0, 2.5 * sigma(accuracy, dr, drift)))]
        if near or wide:
            found, step = (near, "radius") if near else (wide, "wider")
        elif n:
            found, step = [(name, onto(lat, lng, roads[name][2])) for name, _ in options[-1]], "projected"
        else:
            found, step = [every[0][1:]], "nearest"
        options.append(found)
        steps.append(step)

    def emission(x, n):
        return max(-100.0, -log(sqrt(2 * pi) * weights[n]) - 0.5 * (x[0] / weights[n]) ** 2)

    known = {}
    scores, back = [emission(x, 0) for _, x in options[0]], []
    for n in range(1, len(kept)):
        (t0, _, _, v0, _, d0, _), (t1, _, _, v1, _, d1, _) = kept[n - 1], kept[n]
        beta = max(5.0, min(25.0, 5 + 0.25 * max(v0, v1) / 3.6 * max(0.1, (t1 - t0) / 1000) + (4.0 if d0 or d1 else 0.0)))
        new, chosen = [], []
        for name, x in options[n]:
            tried = []
            for s, (was, y) in zip(scores, options[n - 1], strict=True):
                if was == name:
                    ahead = x[1] - y[1]
                    route = ahead if ahead >= 0 else -ahead * 1.5 if -ahead < 30 else inf
                else:
                    end, start = roads[was][1], roads[name][0]
                    if end not in known:
                        known[end] = search(graph, end, 3000.0)
                    way = 0.0 if end == start else known[end].get(start, inf) if end in leaving and start in leaving else inf
                    route = max(0.0, roads[was][3] - y[1]) + way + x[1]
                move = -60.0 if route == inf else max(-100.0, -log(beta) - abs(route - plain.metres(y[2], y[3], x[2], x[3])) / beta)
                tried.append(s + move)
            best = max(range(len(tried)), key=tried.__getitem__)
            chosen.append(best)
            new.append(tried[best] + emission(x, n))
        scores = new
        back.append(chosen)
    at = max(range(len(scores)), key=scores.__getitem__)
    path = [at]
    for chosen in reversed(back):
        path.append(chosen[path[-1]])
    out = [None] * len(rows)
    for n, i in enumerate(reversed(path)):
        name, x = options[n][i]
        for row in kept[n][6]:
            out[row] = (name, x[2], x[3], steps[n])
    return out


def town(rng, side=5, gap=150.0):
    spots = {(r, c): r * side + c for r in range(side) for c in range(side)}
    edges = []
    for p in spots:
        for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)):
            if q in spots and rng.random() < 0.85:
                middle = place(gap * (p[1] + q[1]) / 2 + rng.uniform(-9, 9), gap * (p[0] + q[0]) / 2 + rng.uniform(-9, 9))
                edges.append((len(edges), spots[p], spots[q], rng.random() < 0.3, [place(gap * p[1], gap * p[0]), middle, place(gap * q[1], gap * q[0])]))
    return edges


def test_like_a_plain_matcher(spark):
    rng = random.Random(6)
    edges, rows = town(rng), {}
    for session in (1, 2, 3):
        x, y, rows[session] = (-400.0 if session == 2 else 100.0), 100.0, []
        for i in range(30):
            x, y = (x + rng.uniform(-20, 60), y + rng.uniform(-20, 60)) if i % 10 < 7 else (x + rng.uniform(-3, 3), y)
            dr = (i % 8 > 2) if session != 3 else i < 20
            rows[session].append((i * 1700, *place(x, y), 0.4 if i % 10 > 6 else rng.uniform(5, 60), rng.choice([None, -1.0, 3.0, 12.0]), dr))
    frame = spark.createDataFrame([(s, i + 1, *r) for s, mine in rows.items() for i, r in enumerate(mine)], ROWS)
    roads = spark.createDataFrame([(*e[:4], [{"lat": a, "lng": b} for a, b in e[4]]) for e in edges], EDGES)
    found = {(r["session_id"], r["seq"]): r for r in A.match_adaptive(frame, roads).collect()}
    assert len(found) == 90
    seen = set()
    for session, mine in rows.items():
        for i, (_, lat, lng, step) in enumerate(plain_match(mine, edges)):
            row = found[session, i + 1]
            assert row["step"] == step
            assert abs(row["matched_lat"] - lat) < 1e-9 and abs(row["matched_lng"] - lng) < 1e-9
            # at a crossing, and on a street and its twin, edges are equally likely but for the last bits of sums of lengths
            assert onto(lat, lng, edges[int(row["edge_id"].removesuffix("_rev"))][4])[0] < 1e-3
            seen.add(step)
    assert seen == {"radius", "wider", "projected", "nearest"}


def test_far_and_without_edges(spark):
    roads = spark.createDataFrame([(1, 1, 2, False, [{"lat": 80.0, "lng": 179.999}, {"lat": 80.0, "lng": -179.999}]), (2, 3, 4, True, [{"lat": 10.0, "lng": 20.0}, {"lat": 10.01, "lng": 20.0}])], EDGES)
    points = spark.createDataFrame([(1, 80.0004, -179.9995), (2, 80.0004, 179.9995), (3, 11.0, 20.0), (4, -60.0, -100.0)], "id long, lat double, lng double")
    found = {r["id"]: r for r in A.nearest_edges(points, roads, keys=["id"]).collect()}
    assert {i: found[i]["edge_id"] for i in (1, 2, 3)} == {1: 1, 2: 1, 3: 2} and 4 in found
    assert all(abs(found[i]["distance_m"] - 44.5) < 0.5 for i in (1, 2))
    rows = spark.createDataFrame([(1, 1, 0, 10.0, 20.0, 50.0, 5.0, False)], ROWS)
    assert [r["edge_id"] for r in A.match_adaptive(rows, roads.where("false")).collect()] == [None]
    assert A.match_adaptive(rows.where("false"), roads).count() == 0
