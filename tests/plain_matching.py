"""A plain map matcher: a search over a graph in memory and one Viterbi pass over lists."""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf, log, pi, sqrt

import numpy as np

from waymark.functions.geodesy import RADIUS_MEAN
from waymark.operators.matching import BACKWARD_FACTOR, BACKWARD_M, BROKEN


def metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return float(2 * RADIUS_MEAN * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))


class RoadGraph:
    """Adjacency lists of directed edges, with lengths; keeps searches, to go on from where they stopped."""

    #: Nodes that the kept searches may have settled; beyond, the oldest searches go.
    REMEMBERED = 3_000_000

    def __init__(self, edges: Iterator[tuple[int, int, float]]):
        self.out: dict[int, list[tuple[int, float]]] = {}
        self.entered: set[int] = set()
        self.known: dict[int, tuple[dict[int, float], list[tuple[float, int]]]] = {}
        self.settled = 0
        for u, v, length in edges:
            self.out.setdefault(u, []).append((v, length))
            self.entered.add(v)

    def distances(self, source: int, wanted: set[int], most: float = inf) -> dict[int, float]:
        """Shortest lengths from `source` to the wanted nodes it reaches, within `most` metres."""
        if source not in self.known:
            while self.settled > self.REMEMBERED:
                self.settled -= len(self.known.pop(next(iter(self.known)))[0])
            self.known[source] = {}, [(0.0, source)]
        found, open_nodes = self.known[source]
        before, missing = len(found), {v for v in wanted if v not in found and (v in self.entered or v == source)}
        while missing and open_nodes and open_nodes[0][0] <= most:
            far, u = heapq.heappop(open_nodes)
            if u in found:
                continue
            found[u] = far
            missing.discard(u)
            for v, length in self.out.get(u, ()):
                if v not in found:
                    heapq.heappush(open_nodes, (far + length, v))
        self.settled += len(found) - before
        return {v: found[v] for v in wanted if v in found and found[v] <= most}


@dataclass
class Candidate:
    edge: int | None  # None: off the roads
    start: int | None
    end: int | None
    oneway: bool
    length: float
    offset: float
    lat: float
    lng: float
    distance: float


def same_edge(a: Candidate, b: Candidate) -> float | None:
    """Route along one edge; None if it has to leave it."""
    if b.offset >= a.offset:
        return b.offset - a.offset
    back = a.offset - b.offset
    if not a.oneway:
        return back
    return back * BACKWARD_FACTOR if back < BACKWARD_M else None


def viterbi(points: list[tuple[float, float, float | None]], candidates: list[list[Candidate]], graph: RoadGraph, *, sigma: float, beta: float, most: float = inf) -> tuple[list[Candidate], float]:
    """Most likely candidate of each point, and the log likelihood. Of equal scores the first candidate wins."""

    def emission(c: Candidate, accuracy: float | None) -> float:
        s = max(2.0, min(accuracy, 30.0)) if accuracy is not None and accuracy > 1 else sigma
        return -log(sqrt(2 * pi) * s) - 0.5 * (c.distance / s) ** 2

    scores = [emission(c, points[0][2]) for c in candidates[0]]
    back: list[list[int]] = []
    for t in range(1, len(points)):
        (lat0, lng0, _), (lat, lng, accuracy) = points[t - 1], points[t]
        still = metres(lat0, lng0, lat, lng) < 0.5
        starts = {c.start for c in candidates[t] if c.edge is not None}
        reach = {u: graph.distances(u, starts, most) for u in {c.end for c in candidates[t - 1] if c.edge is not None}}
        new, chosen = [], []
        for b in candidates[t]:
            best, best_at = -inf, 0
            for i, a in enumerate(candidates[t - 1]):
                same = a.edge is not None and a.edge == b.edge
                if still and same:
                    move = 0.0
                else:
                    route = same_edge(a, b) if same else None
                    if route is None and a.edge is not None and b.edge is not None:
                        between = reach[a.end].get(b.start)
                        route = None if between is None else max(0.0, a.length - a.offset) + between + max(0.0, b.offset)
                    move = BROKEN if route is None else -log(beta) - abs(route - metres(a.lat, a.lng, b.lat, b.lng)) / beta
                if scores[i] + move > best:
                    best, best_at = scores[i] + move, i
            new.append(best + emission(b, accuracy))
            chosen.append(best_at)
        scores = new
        back.append(chosen)
    at = max(range(len(scores)), key=scores.__getitem__)
    total, path = scores[at], [at]
    for chosen in reversed(back):
        path.append(chosen[path[-1]])
    return [candidates[t][i] for t, i in enumerate(reversed(path))], total
