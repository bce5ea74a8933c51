"""Road graphs and spatial joins. Space is cut into buckets, so every join is an equi-join on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from waymark.functions import geodesy as G
from waymark.functions.checkpoints import cut, written
from waymark.functions.labels import step_instruction, vehicle_instruction
from waymark.operators.nearest import METRES_A_DEGREE, nearest

#: Segments in one pack of a bucket, about.
PACK = 64
#: Columns of buckets that are looked for together.
BLOCK = 256


def junction_edges(ways: DataFrame) -> DataFrame:
    """Edges between junctions of the ways (way_id, oneway, nodes: array of (node_id, lat, lng)).

    A way is cut at its ends and at nodes that ways use twice or more (twice within one way counts
    too). Each edge has an id of way, start and end, and a reversed twin unless one-way.
    """
    points = ways.select("way_id", "oneway", F.size("nodes").alias("n"), F.posexplode("nodes").alias("at", "node"))
    used = points.groupBy("node.node_id").agg(F.count(F.lit(1)).alias("uses"))
    marked = points.join(used.withColumnRenamed("node_id", "_id"), F.col("node.node_id") == F.col("_id"))
    inner = ((F.col("uses") >= 2) & (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)).cast("int")
    order = W.partitionBy("way_id").orderBy("at")
    pieces = marked.withColumns({"_cut": inner}).withColumn("piece", F.sum("_cut").over(order) - F.col("_cut"))
    # a cut node ends one piece and begins the next
    doubled = pieces.select("way_id", "oneway", "at", "node", "piece").union(pieces.where("_cut = 1").select("way_id", "oneway", "at", "node", F.col("piece") + 1))
    lines = doubled.groupBy("way_id", "oneway", "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda p: p["node"]).alias("nodes")).where(F.size("nodes") >= 2)
    forward = lines.select(F.concat_ws("_", "way_id", F.element_at("nodes", 1)["node_id"], F.element_at("nodes", -1)["node_id"]).alias("edge_id"), "oneway", "nodes")
    twins = forward.where(~F.col("oneway").isin("yes", "1")).select(F.concat("edge_id", F.lit("_rev")).alias("edge_id"), "oneway", F.reverse("nodes").alias("nodes"))
    edges = forward.union(twins)
    return edges.select("edge_id", "oneway", F.element_at("nodes", 1)["node_id"].alias("from_node"), F.element_at("nodes", -1)["node_id"].alias("to_node"), polyline_length("nodes").alias("length_m"), F.size("nodes").cast("long").alias("n_points"), "nodes")


def polyline_length(nodes: str) -> Column:
    """Metres along an array of (lat, lng) points."""
    pairs = F.zip_with(F.slice(nodes, 1, F.size(nodes) - 1), F.slice(nodes, 2, F.size(nodes) - 1), lambda a, b: G.haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def way_segments(ways: DataFrame, nodes: DataFrame, excluded: list[str]) -> DataFrame:
    """Two-point segments of ways (way_id, road_type, refs: array of node ids) joined to their nodes; unknown nodes are skipped."""
    refs = ways.where(~F.col("road_type").isin(*excluded)).select("way_id", "road_type", F.posexplode("refs").alias("at", "node_id"))
    located = refs.join(nodes.select("node_id", "lat", "lng"), "node_id")
    order = W.partitionBy("way_id").orderBy("at")
    ahead = located.withColumns({"lat2": F.lead("lat").over(order), "lng2": F.lead("lng").over(order), "at2": F.lead("at").over(order)}).where("at2 IS NOT NULL")
    return ahead.select("way_id", "road_type", F.col("at").cast("long").alias("at"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), "lat2", "lng2", G.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("length_m"), F.degrees(G.bearing_radians(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).alias("heading"))


def node_degrees(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def merged_edges(cells: list[DataFrame], key: str = "edge_id", order: str = "cell_order") -> DataFrame:
    """Edges of several cells; of one id the edge of the first cell stays."""
    every = cells[0]
    for c in cells[1:]:
        every = every.unionByName(c)
    return every.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def components(edges: DataFrame) -> DataFrame:
    """node_id and component (its smallest node) of an undirected graph (from_node, to_node).

    The graph is contracted: each node goes to the least neighbour of its least neighbour (or stays),
    in an order by hash, so that about a third of the nodes is left, however long a chain and however
    it is numbered. All rounds together read a small multiple of the edges; labels then go back round
    by round. An edge with a null end is a loop at the other one.
    """
    whole = isinstance(edges.schema["from_node"].dataType, IntegralType)

    def name(of: str) -> Column:
        # different for different whole numbers; with the value where the hash alone may be the same
        return F.xxhash64(F.col(of).cast("long")) if whole else F.struct(F.xxhash64(of).alias("hash"), F.col(of).alias("of"))

    def up(links: DataFrame, key: str, names: tuple[Column, Column]) -> DataFrame:
        """Each node with its name and its least neighbour, or itself."""
        both = links.select(F.col("a").alias(key), names[0].alias("name"), names[1].alias("up")).union(links.select(F.col("b"), names[1], names[0]))
        return both.groupBy(key).agg(F.min(F.least("name", "up")).alias("up"), F.first("name").alias("own"))

    links = written(edges.select(F.coalesce("from_node", "to_node").alias("a"), F.coalesce("to_node", "from_node").alias("b")).where("a IS NOT NULL"))
    tree = written(up(links, "least", (name("a"), name("b"))).withColumnRenamed("own", "name"))
    ends, rounds, done = (name("a"), name("b")), [], []
    while True:
        to = written(tree.join(tree.select(F.col("name").alias("up"), F.col("up").alias("to")), "up").select("least", "name", "to"))
        rounds.append(to)
        target = [to.select(F.col("name").alias(f"_{c}"), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = links.withColumns({"_a": ends[0], "_b": ends[1]}).join(target[0], "_a").join(target[1], "_b").where("to_a <> to_b")
        links = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        nodes = to.groupBy("to").agg(F.min("least").alias("least"))
        going = up(links, "to", (F.col("a"), F.col("b"))).select("to", "up")
        every = written(nodes.join(going, "to", "left").select("least", F.col("to").alias("name"), "up"))
        done.append(every.where("up IS NULL").select("name", F.col("least").alias("component")))
        if links.isEmpty():
            break
        tree, ends = every.where("up IS NOT NULL"), (F.col("a"), F.col("b"))
    labels = done.pop()
    for to, ended in zip(reversed(rounds[1:]), reversed(done), strict=True):
        labels = written(to.join(labels.withColumnRenamed("name", "to"), "to").select("name", "component")).union(ended)
    return rounds[0].join(labels.withColumnRenamed("name", "to"), "to").select(F.col("least").alias("node_id"), "component")


def bucket(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size))


def with_buckets(segments: DataFrame, size: float, margin: float = 0.0, asked: DataFrame | None = None) -> DataFrame:
    """Each segment once for each bucket its bounding box touches, widened by `margin` degrees of latitude each way and as many metres east and west; of the `asked` buckets (_row, _col) only, if given.

    A metre has more degrees of longitude the nearer to a pole, so the margin is that of the
    segment's own end farther from the equator. Columns go round at 180 degrees. There a segment
    may lie in all columns, so asked rows are taken first, then blocks of BLOCK columns with an
    asked one, and only their columns are made.
    """
    rows_of = [bucket(F.least("lat1", "lat2") - margin, size), bucket(F.greatest("lat1", "lat2") + margin, size)]
    wide = F.least(F.lit(180.0), margin / F.cos(F.radians(F.least(F.lit(89.999), F.greatest(F.abs("lat1"), F.abs("lat2")) + margin))))
    low, high = bucket(F.least("lng1", "lng2") - wide, size), bucket(F.greatest("lng1", "lng2") + wide, size)
    every = round(360 / size)
    filed = segments.withColumn("_row", F.explode(F.sequence(*rows_of)))
    if asked is None:
        return filed.withColumn("_col", F.explode(F.sequence(low, F.least(high, low + every - 1)))).withColumn("_col", F.pmod("_col", F.lit(every)))
    filed = filed.join(asked.select("_row").distinct(), "_row", "left_semi")
    # from a column of the first turn, so that all are of the first two
    begin = F.pmod(low, F.lit(every))
    ends = filed.withColumns({"_begin": begin, "_end": begin + F.least(high - low, F.lit(every - 1))})
    cut_up = ends.withColumn("_block", F.explode(F.sequence(F.expr(f"_begin div {BLOCK}"), F.expr(f"_end div {BLOCK}"))))
    turns = asked.select("_row", F.explode(F.array("_col", F.col("_col") + every)).alias("_col"))
    blocks = cut_up.join(turns.select("_row", F.expr(f"_col div {BLOCK}").alias("_block")).distinct(), ["_row", "_block"], "left_semi")
    columns = F.sequence(F.greatest("_begin", F.col("_block") * BLOCK), F.least("_end", F.col("_block") * BLOCK + (BLOCK - 1)))
    each = blocks.withColumn("_col", F.explode(columns)).withColumn("_col", F.pmod("_col", F.lit(every))).drop("_begin", "_end", "_block")
    return each.join(asked, ["_row", "_col"], "left_semi")


def edge_candidates(points: DataFrame, segments: DataFrame, *, keys: list[str], radius: float = 50.0, k: int = 5, size: float = 0.001) -> DataFrame:
    """The `k` nearest segments within `radius` metres of each point; of those equally near to a micrometre the smaller edge_id first."""
    found = near_lists(points, segments, keys=keys, radius=radius, k=k, size=size)
    each = found.select(*points.columns, F.posexplode("near").alias("_place", "_s"))
    return each.select(*points.columns, *(F.col("_s")[c].alias(c) for c in (*segments.columns, "share", "distance_m", "length_m")), (F.col("_place") + 1).alias("rank"), *(F.col("_s")[c].alias(c) for c in ("offset_m", "proj_lat", "proj_lng")))


def near_lists(points: DataFrame, segments: DataFrame, *, keys: list[str], radius: float, k: int, size: float = 0.001, gate: float | None = None, by_edge: bool = False) -> DataFrame:
    """All points with `near`, an array of their `k` nearest segments within `radius` metres by distance, to a micrometre, and edge_id; empty without any.

    An element has the segment's columns, share, distance_m, length_m, offset_m, proj_lat and
    proj_lng. With `gate` (degrees) points have `_asked` and segments `_along` (see `nearest`). With
    `by_edge` segments have leg and before_m (`polyline_segments`), an edge counts by its nearest
    segment, and offset_m by the way along the edge.

    Segments are filed under all buckets within the radius where points are, in packs of about PACK,
    so a point looks into its own bucket only and its pairs are never dealt out again, nor ever
    rows; only points of buckets with several packs are brought together by `keys`.
    """
    placed = _in_buckets(points, size)
    filed = written(_filed_near(placed, segments, size, radius))
    sizes = filed.groupBy("_row", "_col").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
    dealt = filed.join(sizes, ["_row", "_col"]).withColumn("_pack", F.pmod(F.xxhash64("edge_id", "lat1", "lng1", "lat2", "lng2"), F.col("_packs")))
    packs = written(dealt.groupBy("_row", "_col", "_packs", "_pack").agg(F.collect_list(F.struct(*segments.columns)).alias("_segments")))
    looked = placed.join(packs, ["_row", "_col"], "left")

    def lists(of: str) -> DataFrame:
        return nearest(looked.where(of), points.columns, radius=radius, k=k, by_edge=by_edge, gate=gate)

    one = lists("coalesce(_packs, 1) = 1")
    if not packs.where("_packs > 1").isEmpty():
        ordered = F.array_sort(F.flatten(F.collect_list("near")))
        if by_edge:
            edges = F.slice(F.array_distinct(F.transform("_ordered", lambda s: s["edge_id"])), 1, k)
            first = F.transform(edges, lambda e: F.get(F.filter("_ordered", lambda s: s["edge_id"].eqNullSafe(e)), F.lit(0)))
        else:
            first = F.slice("_ordered", 1, k)
        several = lists("_packs > 1").groupBy(*keys).agg(F.first(F.struct(*points.columns)).alias("_point"), ordered.alias("_ordered"))
        one = one.unionByName(several.select("_point.*", first.alias("near")))
    return one


def _in_buckets(points: DataFrame, size: float) -> DataFrame:
    # the only trigonometry of a pair, once a point: metres of a degree of longitude
    return points.withColumns({"_row": bucket(F.col("lat"), size), "_col": F.pmod(bucket(F.col("lng"), size), F.lit(round(360 / size))), "_east": METRES_A_DEGREE * F.cos(F.radians("lat"))})


def _filed_near(placed: DataFrame, segments: DataFrame, size: float, radius: float) -> DataFrame:
    """Segments under all buckets within the radius, of those buckets only where points are: elsewhere no row is dealt out."""
    asked = written(placed.where("_row IS NOT NULL AND _col IS NOT NULL").select("_row", "_col").distinct())
    return with_buckets(segments, size, radius / METRES_A_DEGREE, asked)


def segments_within(points: DataFrame, segments: DataFrame, radius: float, size: float) -> DataFrame:
    """Pairs of point and segment within `radius` metres, with share, distance_m and length_m."""
    placed = _in_buckets(points, size)
    filed = _filed_near(placed, segments, size, radius)
    # what is too far north or south needs no geometry
    high = radius / METRES_A_DEGREE + 1e-9
    near = placed.join(filed, ["_row", "_col"]).where((F.col("lat") >= F.least("lat1", "lat2") - high) & (F.col("lat") <= F.greatest("lat1", "lat2") + high))
    share, distance, length = _on_plane()
    return near.withColumns({"share": share, "distance_m": distance, "length_m": length}).where(F.col("distance_m") <= radius)


def polyline_segments(edges: DataFrame) -> DataFrame:
    """Two-point segments of edges (edge_id, points: array of (lat, lng)) with the metres of their edge before them."""
    legs = edges.select("edge_id", F.posexplode(F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("leg", "ends"))
    placed = legs.select("edge_id", "leg", F.col("ends.a.lat").alias("lat1"), F.col("ends.a.lng").alias("lng1"), F.col("ends.b.lat").alias("lat2"), F.col("ends.b.lng").alias("lng2"))
    length = G.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    before = F.sum(length).over(W.partitionBy("edge_id").orderBy("leg")) - length
    return placed.withColumn("before_m", before)


def nearest_on_segments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of pairs of points and segments (`polyline_segments`) the nearest for each of `keys`, of equally near ones the smallest edge and its first leg: keys, edge_id, offset_m, proj_lat, proj_lng, distance_m."""
    if "distance_m" not in pairs.columns:
        placed = pairs.withColumn("_east", METRES_A_DEGREE * F.cos(F.radians("lat")))
        share, distance, length = _on_plane()
        pairs = placed.withColumns({"share": share, "distance_m": distance, "length_m": length})
    offset = F.col("before_m") + F.col("share") * F.col("length_m")
    lat, lng = (F.col(f"{c}1") + F.col("share") * (F.col(f"{c}2") - F.col(f"{c}1")) for c in ("lat", "lng"))
    at = F.struct("edge_id", offset.alias("offset_m"), lat.alias("proj_lat"), lng.alias("proj_lng"), "distance_m")
    best = pairs.groupBy(*keys).agg(F.min_by(at, F.struct(F.round("distance_m", 6), "edge_id", "leg")).alias("_at"))
    return best.select(*keys, *(F.col("_at")[c].alias(c) for c in ("edge_id", "offset_m", "proj_lat", "proj_lng", "distance_m") if c not in keys))


def polyline_candidates(points: DataFrame, edges: DataFrame, *, keys: list[str], radius: float = 60.0, k: int = 8, size: float = 0.001) -> DataFrame:
    """The `k` nearest edges (edge_id, points: array of (lat, lng)) within `radius` metres of each point.

    An edge counts by its nearest segment, of equally near ones the first; `offset_m` is the way
    along the edge to the projection. Edges of fewer than two points have no segments.
    """
    found = near_lists(points, polyline_segments(edges.where(F.size("points") >= 2)), keys=keys, radius=radius, k=k, size=size, by_edge=True)
    each = found.select(*keys, F.posexplode("near").alias("_place", "_s"))
    return each.select(*keys, "_s.edge_id", (F.col("_place") + 1).alias("rank"), *(F.col("_s")[c].alias(c) for c in ("offset_m", "proj_lat", "proj_lng", "distance_m")))


def _short_way(degrees: Column) -> Column:
    """A difference of longitudes, across the 180th degree where that is shorter."""
    return F.when(degrees > 180, degrees - 360).when(degrees < -180, degrees + 360).otherwise(degrees)


def _on_plane() -> tuple[Column, Column, Column]:
    """(share, distance, length) of a pair in metres, on the plane that touches at the point."""
    ax, bx = (_short_way(F.col(f"lng{i}") - F.col("lng")) * F.col("_east") for i in (1, 2))
    ay, by = ((F.col(f"lat{i}") - F.col("lat")) * METRES_A_DEGREE for i in (1, 2))
    zero = F.lit(0.0)
    share = G.along_segment(zero, zero, ax, ay, bx, by, 1e-12)
    x, y = ax + share * (bx - ax), ay + share * (by - ay)
    return share, F.sqrt(x * x + y * y), F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def snapped(points: DataFrame, segments: DataFrame, *, keys: list[str], most: float = 20.0, size: float = 0.001, heading: str | None = None, speed: str | None = None, gate: float = 45.0) -> DataFrame:
    """Each point with its nearest segment within `most` metres, null without, and a confidence, 0 without.

    With a `heading` column (degrees), points faster than 1 m/s (`speed`; without that column all)
    take only segments that differ by at most `gate` degrees, either way along unless `oneway`, and
    ten times the difference in radians counts as metres. A null heading or speed asks for nothing.
    """
    if heading:
        moving = F.col(heading).isNotNull() & (F.col(speed) > 1.0 if speed else F.lit(True))
        asking = points.withColumn("_asked", F.when(F.coalesce(moving, F.lit(False)), F.col(heading).cast("double")))
        directed = segments.withColumn("_along", F.degrees(G.bearing_radians(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))))
        found = near_lists(asking, directed, keys=keys, radius=most, k=1, size=size, gate=gate)
    else:
        found = near_lists(points, segments, keys=keys, radius=most, k=1, size=size)
    best = F.get("near", F.lit(0))
    joined = found.select(*points.columns, *(best[c].alias(c) for c in ("edge_id", "distance_m", "proj_lat", "proj_lng")))
    return joined.withColumn("confidence", F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("distance_m") / most), F.lit(0.0)))


def nearest_nodes(points: DataFrame, nodes: DataFrame, *, keys: list[str], size: float = 0.005) -> DataFrame:
    """The nearest node of each point in raw degrees, ties to the smaller id; none for points without a place.

    Nodes are filed under their own bucket and the eight around it, where points are, in buckets of
    three widths, in packs of about PACK; a point looks into its own and leaves once its best is
    nearer than a bucket is wide. Points with no node so near go down from the bucket that holds all nodes.
    """
    ids = nodes.select("node_id", F.col("lat").alias("node_lat"), F.col("lng").alias("node_lng"))
    far = F.hypot(F.col("lat") - F.col("node_lat"), F.col("lng") - F.col("node_lng"))
    nearest = F.min(F.struct(far.alias("_far"), "node_id")).alias("_best")
    named = [*keys, F.col("_best.node_id").alias("node_id"), F.col("_best._far").alias("degrees")]
    left, done = points.select(*keys, "lat", "lng").where((F.abs("lat") < float("inf")) & (F.abs("lng") < float("inf"))), None
    for side in (size / 5, size, 4 * size):
        placed = left.withColumns({"_row": bucket(F.col("lat"), side), "_col": bucket(F.col("lng"), side)})
        asked = written(placed.select("_row", "_col").distinct())
        around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        spread = ids.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).select("node_id", "node_lat", "node_lng", (bucket(F.col("node_lat"), side) + F.col("_a")).alias("_row"), (bucket(F.col("node_lng"), side) + F.col("_b")).alias("_col"))
        near = written(spread.join(asked, ["_row", "_col"], "left_semi"))
        sizes = near.groupBy("_row", "_col").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
        dealt = near.join(sizes, ["_row", "_col"]).withColumn("_pack", F.pmod(F.xxhash64("node_id"), F.col("_packs")))
        packs = written(dealt.groupBy("_row", "_col", "_packs", "_pack").agg(F.collect_list(F.struct("node_id", "node_lat", "node_lng")).alias("_nodes")))
        best = F.array_min(F.transform("_nodes", lambda n: F.struct(F.hypot(F.col("lat") - n["node_lat"], F.col("lng") - n["node_lng"]).alias("_far"), n["node_id"].alias("node_id"))))
        looked = placed.join(packs, ["_row", "_col"], "left").withColumn("_best", best)
        tried = looked.where("coalesce(_packs, 1) = 1").select(*keys, "lat", "lng", "_best")
        if not packs.where("_packs > 1").isEmpty():
            tried = tried.unionByName(looked.where("_packs > 1").groupBy(*keys).agg(F.first("lat").alias("lat"), F.first("lng").alias("lng"), F.min("_best").alias("_best")))
        tried = written(tried.withColumn("_sure", F.coalesce(F.col("_best._far") <= side, F.lit(False))))
        sure = tried.where("_sure").select(*named)
        done = sure if done is None else done.union(sure)
        left = tried.where("NOT _sure").select(*keys, "lat", "lng")
        if left.isEmpty():
            return done
    filed = ids.withColumns({"_row": bucket(F.col("node_lat"), size), "_col": bucket(F.col("node_lng"), size)})
    reached = _nearest_buckets(left, filed, keys)
    return done if reached is None else done.union(reached.join(filed, ["_row", "_col"]).groupBy(*keys).agg(nearest).select(*named))


def _nearest_buckets(points: DataFrame, filed: DataFrame, keys: list[str]) -> DataFrame | None:
    """Pairs of point and bucket that may hold its nearest node, by halving buckets from the one of all nodes; None without nodes.

    A bucket stays while the box around its nodes begins no farther than the nearest box of the point ends.
    """
    fine = cut(filed.groupBy("_row", "_col").agg(F.min("node_lat").alias("low_lat"), F.max("node_lat").alias("high_lat"), F.min("node_lng").alias("low_lng"), F.max("node_lng").alias("high_lng")))
    ends = fine.agg(F.min("_row"), F.max("_row"), F.min("_col"), F.max("_col")).first()
    if ends[0] is None:
        return None
    top = 0
    while (ends[1] >> top) - (ends[0] >> top) > 1 or (ends[3] >> top) - (ends[2] >> top) > 1:
        top += 1
    near = points.withColumn("_up", F.lit(0))
    for level in range(top, -1, -1):
        halved = [F.shiftright(c, level).alias(c) for c in ("_row", "_col")]
        boxes = fine.groupBy(*halved).agg(F.min("low_lat").alias("low_lat"), F.max("high_lat").alias("high_lat"), F.min("low_lng").alias("low_lng"), F.max("high_lng").alias("high_lng"))
        if level == top:
            tried = near.drop("_up").crossJoin(F.broadcast(boxes))  # four at most
        else:
            tried = near.join(boxes.withColumns({"_up_row": F.shiftright("_row", 1), "_up_col": F.shiftright("_col", 1)}), ["_up_row", "_up_col"])
        gap = [F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0)) for c in ("lat", "lng")]
        span = [F.greatest(F.abs(F.col(c) - F.col(f"low_{c}")), F.abs(F.col(c) - F.col(f"high_{c}"))) for c in ("lat", "lng")]
        bounds = tried.withColumns({"_begins": F.hypot(*gap), "_bar": F.min(F.hypot(*span)).over(W.partitionBy(*keys))})
        kept = bounds.where(F.col("_begins") <= F.col("_bar") * (1 + 1e-9)).select(*keys, "lat", "lng", "_row", "_col")
        near = cut(kept if level == 0 else kept.withColumnsRenamed({"_row": "_up_row", "_col": "_up_col"}))
    return near


def uncovered_spans(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Spans with a point whose own cell is not stored, and how many."""
    missing = points.withColumn("cell_key", G.cell_key(F.col("lat"), F.col("lng"))).join(cells.select("cell_key").distinct(), "cell_key", "left_anti")
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"))


def route_remaining(points: DataFrame, route: DataFrame, keys: list[str]) -> DataFrame:
    """Metres to the end of a route, and off it, for each point.

    `route` has (route_id, seq, lat, lng); a point has a route_id and is projected, in raw degrees,
    on the segments of its own route; the one nearest in metres counts, the first of equally near
    ones. A position that is null, no number or within 1e-4 degrees of (0, 0) has the whole route
    ahead, and is 0 m off it. A route is bounded by what one trip has, so the equi-join on it is too.
    """
    order = W.partitionBy("route_id").orderBy("seq")
    ahead = route.withColumns({"lat2": F.lead("lat").over(order), "lng2": F.lead("lng").over(order)}).where("lat2 IS NOT NULL").withColumnsRenamed({"lat": "lat1", "lng": "lng1"})
    sized = ahead.withColumn("_len", G.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")))
    legs = sized.withColumn("_after", F.sum("_len").over(W.partitionBy("route_id").orderBy(F.desc("seq"))) - F.col("_len")).select("route_id", F.col("seq").alias("leg"), "lat1", "lng1", "lat2", "lng2", "_after")
    _, lat, lng = G.project(*(F.col(c) for c in ("lat", "lng", "lat1", "lng1", "lat2", "lng2")), scaled=False)
    known = ~(F.col("lat").isNull() | F.col("lng").isNull() | F.isnan("lat") | F.isnan("lng") | ((F.abs("lat") < 1e-4) & (F.abs("lng") < 1e-4)))
    # an unknown position stands at the route's start
    start = legs.groupBy("route_id").agg(F.min_by(F.struct("lat1", "lng1"), "leg").alias("_start"))
    placed = points.join(start, "route_id").withColumn("_known", known).withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_start.{c}1")) for c in ("lat", "lng")})
    tried = placed.join(legs, "route_id").withColumns({"_lat": lat, "_lng": lng}).withColumn("_off", F.round(G.haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")), 6))
    best = tried.groupBy(*keys).agg(F.min_by(F.struct("lat", "lng", "_lat", "_lng", "lat2", "lng2", "_after", "leg"), F.struct("_off", "leg")).alias("b"))
    rest = G.haversine(F.col("b._lat"), F.col("b._lng"), F.col("b.lat2"), F.col("b.lng2")) + F.col("b._after")
    off = G.haversine(F.col("b.lat"), F.col("b.lng"), F.col("b._lat"), F.col("b._lng"))
    return best.select(*keys, F.col("b.leg").alias("leg"), rest.alias("remaining_m"), off.alias("off_route_m"), (rest <= 50).alias("arrived"))


def out_edges(edges: DataFrame) -> DataFrame:
    """Pairs (edge_id, next_edge): edges that begin where an edge ends."""
    return edges.select("edge_id", F.col("to_node").alias("_at")).join(edges.select(F.col("edge_id").alias("next_edge"), F.col("from_node").alias("_at")), "_at").select("edge_id", "next_edge")


def route_options(responses: DataFrame, body: str = "body", default_kmh: float = 40.0) -> DataFrame:
    """Routes of saved routing answers (JSON, GeoJSON order): km, minutes of at least 1, points as (lat, lng), label.

    The first route is Recommended; the fastest and the shortest of the others are named so. A route
    without a positive duration takes that of its km at `default_kmh`; a missing distance is 0.
    """
    kind = "routes array<struct<distance double, duration double, geometry struct<coordinates array<array<double>>>>>"
    routes = responses.select("request_id", F.posexplode(F.from_json(body, kind)["routes"]).alias("option", "route"))
    km = G.half_up(F.coalesce("route.distance", F.lit(0.0)) / 1000, 1)
    seconds = F.when(F.col("route.duration") > 0, F.col("route.duration")).otherwise(F.floor(km / default_kmh * 3600 + 0.5))
    measured = routes.select("request_id", F.col("option").cast("long").alias("option"), km.alias("km"), F.greatest(F.lit(1).cast("long"), F.floor(seconds / 60 + 0.5)).alias("minutes"), F.transform("route.geometry.coordinates", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng"))).alias("points"))
    one = W.partitionBy("request_id")
    fastest, shortest = F.min_by("option", F.struct("minutes", "option")).over(one), F.min_by("option", F.struct("km", "option")).over(one)
    label = F.when(F.col("option") == 0, "Recommended").when(F.col("option") == fastest, "Fastest").when(F.col("option") == shortest, "Shortest").otherwise("Alternative")
    return measured.withColumn("label", label)


def route_steps(responses: DataFrame, body: str = "body", vehicle: str | None = None) -> DataFrame:
    """Steps of all legs of each route of saved routing answers, numbered from 0 through the route, with their wording: that of the `vehicle` (walking, bike or any other), if given.

    A step without a manoeuvre is a turn, one without a name an unnamed street; metres and seconds are whole.
    """
    kind = "routes array<struct<legs array<struct<steps array<struct<maneuver struct<type string, modifier string>, name string, distance double, duration double>>>>>>"
    routes = responses.select("request_id", F.posexplode(F.from_json(body, kind)["routes"]).alias("option", "route"))
    steps = routes.select("request_id", "option", F.posexplode(F.flatten(F.transform("route.legs", lambda leg: F.coalesce(leg["steps"], F.array())))).alias("step", "s"))
    named, turn = F.coalesce(F.when(F.col("s.name") != "", F.col("s.name")), F.lit("Unnamed Street")), F.coalesce("s.maneuver.type", F.lit("turn"))
    whole = [F.floor(F.coalesce(f"s.{c}", F.lit(0.0)) + 0.5) for c in ("distance", "duration")]
    words = F.col("s.maneuver.modifier"), F.col("s.name")
    spoken = step_instruction(turn, *words) if vehicle is None else vehicle_instruction(F.col("s.maneuver.type"), *words, F.lit(vehicle))
    return steps.select("request_id", F.col("option").cast("long").alias("option"), F.col("step").cast("long").alias("step"), turn.alias("kind"), named.alias("street"), whole[0].alias("distance_m"), whole[1].alias("duration_s"), spoken.alias("instruction"))


def route_summaries(responses: DataFrame, body: str = "body") -> DataFrame:
    """request_id, option and summary of each route of saved routing answers: that of its first leg, else the street of its first step."""
    kind = "routes array<struct<legs array<struct<summary string, steps array<struct<name string>>>>>>"
    routes = responses.select("request_id", F.posexplode(F.from_json(body, kind)["routes"]).alias("option", "route"))
    legs = F.coalesce("route.legs", F.array().cast("array<struct<summary string, steps array<struct<name string>>>>"))
    steps = F.flatten(F.transform(legs, lambda leg: F.coalesce(leg["steps"], F.array().cast("array<struct<name string>>"))))
    first = F.get(steps, F.lit(0))["name"]
    street = F.when(F.size(steps) == 0, "Standard Route").otherwise(F.coalesce(F.when(first != "", first), F.lit("Unnamed Street")))
    given = F.get(legs, F.lit(0))["summary"]
    return routes.select("request_id", F.col("option").cast("long").alias("option"), F.coalesce(F.when(given != "", given), F.concat(F.lit("Via "), street)).alias("summary"))
