"""Route lengths on a road graph by an overlay of cells, without the graph in any one place.

Nodes are dealt to square cells of at most NODES nodes (fuller squares are quartered). Within a cell
one task computes all distances; what leaves it are tables: between border nodes (those with an edge
into another cell), from wanted sources to the border, and from the border to wanted targets. Border
nodes with the edges between cells and the distances inside them are the overlay. A search over many
sources relaxes the overlay by joins, a cell in two rounds, within a radius that doubles until every
pair is answered. A route is then the least sum of three tables: source to border, border to border,
border to target, taken for two cells at a time. Where a search is bounded, only the part of the
graph near its sources is dealt to cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geodesy as G
from waymark.functions.checkpoints import written
from waymark.operators.roads import METRES_A_DEGREE, bucket, with_buckets

#: Most nodes of a cell, degrees of the widest cell, and quarterings after which even a fuller cell stays whole.
NODES, WIDEST, QUARTERINGS = 512, 0.02, 20
#: Metres of the first search; doubled as long as pairs are open.
RADIUS = 2000.0


def cells_of(nodes: DataFrame, most: int = NODES, widest: float = WIDEST) -> DataFrame:
    """node_id and cell (a name) of (node_id, lat, lng): the widest squares with at most `most` nodes."""
    done, left = None, written(nodes)
    for level in range(QUARTERINGS + 1):
        side = widest / 2**level
        named = left.withColumn("cell", F.concat_ws("/", F.lit(level), F.floor(F.col("lat") / side), F.floor(F.col("lng") / side)))
        full = named.groupBy("cell").count().where(F.col("count") > most).select("cell") if level < QUARTERINGS else named.select("cell").where("false")
        fits = named.join(full, "cell", "left_anti").select("node_id", "cell")
        done = fits if done is None else done.unionByName(fits)
        left = written(named.join(full, "cell", "left_semi").drop("cell"))
        if left.isEmpty():
            break
    return written(done)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums over the middle index."""
    out = np.full((a.shape[0], b.shape[1]), np.inf)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[None, k], out=out)
    return out


def all_distances(n: int, start: np.ndarray, end: np.ndarray, metres: np.ndarray) -> np.ndarray:
    """Least lengths between all of n nodes (Floyd and Warshall, a row of paths at a time)."""
    d = np.full((n, n), np.inf)
    np.minimum.at(d, (start, end), metres)
    np.fill_diagonal(d, 0.0)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    return d


def _inside(table: pa.Table) -> pa.Table:
    """Rows of one cell (kind 0 edges, 1 roles of nodes, 2 wanted pairs) to its distances: kind 0 between border nodes, 1 from sources to the border, 2 from the border to targets, 3 of the wanted pairs."""
    kind, a, b, metres = (table.column(c).to_numpy() for c in ("kind", "a", "b", "metres"))
    roads, roles = kind == 0, kind == 1
    names = np.unique(np.concatenate((a[roads], b[roads], a[roles])))
    d = all_distances(len(names), np.searchsorted(names, a[roads]), np.searchsorted(names, b[roads]), metres[roads])
    border, source, target = (np.searchsorted(names, a[roles & (b & bit > 0)]) for bit in (1, 2, 4))
    rows = []
    for number, (u, v) in enumerate(((border, border), (source, border), (border, target))):
        x, y = np.nonzero(np.isfinite(d[np.ix_(u, v)]))
        keep = (u[x] != v[y]) if number == 0 else np.ones(len(x), bool)
        x, y = u[x[keep]], v[y[keep]]
        rows.append((np.full(len(x), number, np.int32), names[x], names[y], d[x, y]))
    wanted = kind == 2
    x, y = np.searchsorted(names, a[wanted]), np.searchsorted(names, b[wanted])
    near = np.isfinite(d[x, y])
    rows.append((np.full(int(near.sum()), 3, np.int32), names[x[near]], names[y[near]], d[x, y][near]))
    cell = table.column("cell")[0].as_py()
    found = [np.concatenate(c) for c in zip(*rows, strict=True)]
    return pa.table({"cell": pa.array([cell] * len(found[0]), pa.string()), **{c: pa.array(x) for c, x in zip(("kind", "a", "b", "metres"), found, strict=True)}})


class Overlay:
    """Tables of the cells: `inner` (cell, kind, a, b, metres), `overlay` (a, b, metres), and the pairs with their cells.

    `edges` has from_node, to_node, length_m and the ends' lat1, lng1, lat2, lng2; pairs whose nodes no
    edge touches are left out, but for those of a node with itself.
    """

    def __init__(self, edges: DataFrame, pairs: DataFrame, nodes_of_cell: int = NODES, widest: float = WIDEST):
        ends = edges.select(F.col("from_node").alias("node_id"), F.col("lat1").alias("lat"), F.col("lng1").alias("lng")).union(edges.select("to_node", "lat2", "lng2"))
        places = ends.groupBy("node_id").agg(F.min(F.struct("lat", "lng")).alias("p")).select("node_id", "p.lat", "p.lng")
        cells = cells_of(places, nodes_of_cell, widest)

        def cell(name: str) -> DataFrame:
            return cells.select(F.col("node_id").alias(name), F.col("cell").alias(f"{name}_cell"))

        roads = written(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("length_m").alias("metres")).join(cell("a"), "a").join(cell("b"), "b"))
        self.pairs = written(pairs.join(cell("source"), "source").join(cell("target"), "target"))
        crossing = roads.where("a_cell <> b_cell")
        flags = [(crossing.select("a"), 1), (crossing.select("b"), 1), (self.pairs.select("source"), 2), (self.pairs.select("target"), 4)]
        marks = [df.toDF("node_id").distinct().withColumn("flag", F.lit(bit).cast("long")) for df, bit in flags]
        roles = marks[0].union(marks[1]).union(marks[2]).union(marks[3]).groupBy("node_id").agg(F.bit_or("flag").alias("b")).join(cells, "node_id")
        rows = roads.where("a_cell = b_cell").select(F.col("a_cell").alias("cell"), F.lit(0).alias("kind"), "a", "b", "metres")
        rows = rows.union(roles.select("cell", F.lit(1), "node_id", "b", F.lit(0.0)))
        rows = rows.union(self.pairs.where("source_cell = target_cell").select("source_cell", F.lit(2), "source", "target", F.lit(0.0)))
        self.inner = written(rows.groupBy("cell").applyInArrow(_inside, "cell string, kind int, a long, b long, metres double"))
        shortest = crossing.groupBy("a", "b").agg(F.min("metres").alias("metres"))
        self.overlay = written(self.inner.where("kind = 0").select("a", "b", "metres").union(shortest))
        self.cells = cells


def _closed(table: pa.Table) -> pa.Table:
    """Pairs of two cells (kind 3) with the least sums of ways to the border (kind 1) and from it (kind 2)."""
    kind, a, b, metres = (table.column(c).to_numpy() for c in ("kind", "a", "b", "metres"))
    out, back, wanted = kind == 1, kind == 2, kind == 3
    sources, targets, borders = np.unique(a[out]), np.unique(b[back]), np.unique(np.concatenate((b[out], a[back])))
    left, right = np.full((len(sources), len(borders)), np.inf), np.full((len(borders), len(targets)), np.inf)
    left[np.searchsorted(sources, a[out]), np.searchsorted(borders, b[out])] = metres[out]
    right[np.searchsorted(borders, a[back]), np.searchsorted(targets, b[back])] = metres[back]
    s, t = a[wanted], b[wanted]
    known = np.isin(s, sources) & np.isin(t, targets)
    s, t = s[known], t[known]
    found = min_plus(left, right)[np.searchsorted(sources, s), np.searchsorted(targets, t)]
    near = np.isfinite(found)
    return pa.table({"source": pa.array(s[near], pa.int64()), "target": pa.array(t[near], pa.int64()), "metres": pa.array(found[near], pa.float64())})


def _answers(o: Overlay, best: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, metres of the pairs that `best` (source, node, metres) or a way inside a cell joins."""
    both = ["source_cell", "target_cell"]
    cells = pairs.select(*both).distinct()
    source = pairs.select("source", "source_cell").distinct()
    border = o.cells.select(F.col("node_id").alias("node"), F.col("cell").alias("target_cell"))
    out = best.join(source, "source").join(border, "node").join(cells, both, "left_semi").select(*both, F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("node").alias("b"), "metres")
    back = cells.join(o.inner.where("kind = 2").withColumnRenamed("cell", "target_cell"), "target_cell").select(*both, "kind", "a", "b", "metres")
    wanted = pairs.select(*both, F.lit(3), "source", "target", F.lit(0.0))
    through = out.union(back).union(wanted).groupBy(*both).applyInArrow(_closed, "source long, target long, metres double")
    inside = o.inner.where("kind = 3").select(F.col("a").alias("source"), F.col("b").alias("target"), "metres").join(pairs, ["source", "target"], "left_semi")
    return through.union(inside).groupBy("source", "target").agg(F.min("metres").alias("metres"))


def within_reach(edges: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """Of the edges at least those that leave a node within `most` metres of a source, or leave a target; written.

    No edge is shorter than a share of the straight line between its ends (a first pass finds the
    share, and the places of the sources), so a route of `most` metres stays within most / share
    metres of its source in a straight line. All edges are kept where there is no such share. A node
    has one place.
    """
    return _near_edges(edges, pairs, most)[0]


def _near_edges(edges: DataFrame, pairs: DataFrame, most: float) -> tuple[DataFrame, bool]:
    """The edges `within_reach`, and whether they are all."""
    wanted = written(pairs.select("source").distinct())
    straight = G.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    share = F.when(straight == 0, None).when(F.col("length_m") >= 0, F.col("length_m") / straight).otherwise(0.0)
    # one group for each source, and one for all other nodes
    marked = edges.join(wanted, F.col("from_node") == F.col("source"), "left").withColumn("share", F.coalesce(F.nanvl(share, F.lit(0.0)), F.when(straight.isNull(), 0.0)))
    places = written(marked.groupBy("source").agg(F.min(F.struct("lat1", "lng1")).alias("p"), F.min("share").alias("share"), F.count(F.lit(1)).alias("n")))
    least, total = places.agg(F.min("share"), F.sum("n")).first()
    if least == 0:
        return written(edges), True
    margin = most / (least or 1.0) / METRES_A_DEGREE * (1 + 1e-6) + 1e-9
    if margin > 45:
        return written(edges), True
    size = 360 / max(1, int(720 / margin))
    at = [bucket(F.col(f"p.{c}"), size) for c in ("lat1", "lng1")]
    boxes = places.where("source IS NOT NULL").groupBy(*at).agg(*(f(f"p.{c}1").alias(f"{c}{n}") for n, f in ((1, F.min), (2, F.max)) for c in ("lat", "lng")))
    near = written(with_buckets(boxes, size, margin).select("_row", "_col", F.lit(True).alias("_near")).distinct())
    targets = written(pairs.select(F.col("target").alias("_target")).distinct())
    filed = edges.withColumns({"_row": bucket(F.col("lat1"), size), "_col": F.pmod(bucket(F.col("lng1"), size), F.lit(round(360 / size)))})
    kept = filed.join(near, ["_row", "_col"], "left").join(targets, F.col("from_node") == F.col("_target"), "left")
    kept = written(kept.where("_near OR _target IS NOT NULL").select(*edges.columns))
    return kept, kept.count() == (total or 0)


def shortest(edges: DataFrame, pairs: DataFrame, *, most: float | None = None, nodes_of_cell: int = NODES, widest: float = WIDEST) -> DataFrame:
    """source, target and metres of the shortest route of each distinct pair (source, target); pairs that no route joins, within `most` metres if given, have no row.

    `edges`: from_node, to_node, length_m, lat1, lng1, lat2, lng2, one row a direction. A node is 0
    metres from itself, on the graph or not. Null ids take no part. Without `most`, pairs are searched
    in what of the graph lies within a bound of their sources, and those left open go on with four
    times the bound, in the end over all edges.
    """
    pairs = written(pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    if most is not None:
        return _searched(within_reach(edges, pairs.where("source <> target"), most), pairs, most, nodes_of_cell, widest)
    found, bound = None, 4 * RADIUS
    while True:
        near, whole = _near_edges(edges, pairs.where("source <> target"), bound)
        part = _searched(near, pairs, None if whole else bound, nodes_of_cell, widest)
        found = part if found is None else found.union(part)
        if whole:
            return found
        pairs = written(pairs.join(part, ["source", "target"], "left_anti"))
        if pairs.isEmpty():
            return found
        bound *= 4


def _searched(edges: DataFrame, pairs: DataFrame, most: float | None, nodes_of_cell: int = NODES, widest: float = WIDEST) -> DataFrame:
    """`shortest` of distinct pairs over all the edges given."""
    done = [written(pairs.where("source = target").withColumn("metres", F.lit(0.0)))]
    o = Overlay(edges, pairs.where("source <> target"), nodes_of_cell, widest)
    best = written(o.inner.where("kind = 1").select(F.col("a").alias("source"), F.col("b").alias("node"), "metres", F.lit(True).alias("open")))
    wanted, radius = o.pairs, RADIUS if most is None else min(RADIUS, most)
    while True:
        near = F.col("open") & (F.col("metres") <= radius)
        while not (going := best.where(near)).isEmpty():
            steps = going.join(o.overlay.withColumnRenamed("metres", "_m"), going["node"] == F.col("a")).select("source", F.col("b").alias("node"), (F.col("metres") + F.col("_m")).alias("metres"), F.lit(True).alias("open"))
            both = best.withColumn("open", F.col("open") & ~near).union(steps)
            # ways of one length differ in the last bits of their sums; that is no reason to go on from a node again
            least = F.min(F.struct(F.round("metres", 9).alias("about"), "open", "metres"))
            best = written(both.groupBy("source", "node").agg(least.alias("x")).select("source", "node", "x.metres", "x.open"))
        found = written(_answers(o, best.drop("open"), wanted))
        last = (most is not None and radius >= most) or best.where("open").isEmpty()
        settled = found.where(F.col("metres") <= radius) if not last or most is not None else found
        done.append(settled)
        wanted = written(wanted.join(settled, ["source", "target"], "left_anti"))
        if last or wanted.isEmpty():
            break
        best = written(best.join(wanted.select("source").distinct(), "source", "left_semi"))
        radius = 2 * radius if most is None else min(2 * radius, most)
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    return found


def bounded_routes(edges: DataFrame, pairs: DataFrame, *, most: float = 3000.0) -> DataFrame:
    """The pairs with `metres` of a search that goes on from nodes within `most` metres of the source only; null where it does not reach.

    A node that such a node leads to counts, though it may lie farther than `most` and though a
    shorter way over a node beyond exists. The target needs an edge that leaves it; without one, or
    without one at the source, there is no route, but for that of a node to itself.
    """
    wanted = written(pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    edges = within_reach(edges, wanted.where("source <> target"), most)
    leaving = edges.select(F.col("from_node").alias("target")).distinct()
    into = edges.groupBy(F.col("from_node").alias("u"), F.col("to_node").alias("target")).agg(F.min("length_m").alias("length_m"))
    last = written(wanted.where("source <> target").join(leaving, "target", "left_semi").join(into, "target"))
    near = _searched(edges, last.select("source", F.col("u").alias("target")).distinct(), most).withColumnRenamed("target", "u")
    found = last.join(near, ["source", "u"]).groupBy("source", "target").agg(F.min(F.col("metres") + F.col("length_m")).alias("metres"))
    found = found.union(wanted.where("source = target").withColumn("metres", F.lit(0.0)))
    return pairs.join(found, ["source", "target"], "left")


def between_candidates(graph_m: Column, *, backward_m: float, backward_factor: float, two_way: Column | None = None) -> Column:
    """Metres from candidate `a` to candidate `b` (structs with edge_id, offset_m, length_m); null without a route.

    Along one edge forwards, or backwards by less than `backward_m` at a factor (by any length on
    `two_way` edges); else to the end of the one edge, over the graph, and on from the start of the other.
    """
    a, b = F.col("a"), F.col("b")
    ahead = b["offset_m"] - a["offset_m"]
    back = F.when(-ahead < backward_m, -ahead * backward_factor)
    if two_way is not None:
        back = F.when(two_way, -ahead).otherwise(back)
    around = F.greatest(F.lit(0.0), a["length_m"] - a["offset_m"]) + graph_m + F.greatest(F.lit(0.0), b["offset_m"])
    return F.when(a["edge_id"] == b["edge_id"], F.when(ahead >= 0, ahead).otherwise(back)).otherwise(around)
