"""The exporter's map matcher: adaptive deviations, widening candidates, bounded routes, and rows expanded again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import labels as L
from waymark.functions.checkpoints import written
from waymark.functions.geodesy import RADIUS_EQUATOR, haversine
from waymark.operators.matching import chosen, viterbi
from waymark.operators.moves import weighed
from waymark.operators.roads import METRES_A_DEGREE, near_lists, nearest_on_segments, polyline_segments, segments_within
from waymark.operators.routes import bounded_routes
from waymark.operators.trips import KEY, ORDER, along

# Fixed values of the candidate search: least and most metres of the first radius, its deviations, the second radius, and candidates of a row.
LEAST_M, MOST_M, DEVIATIONS, WIDER_M, CANDIDATES = 30.0, 60.0, 2.5, 80.0, 8
# Fixed values of the same-edge rule: metres of tolerated backward motion, and its factor; metres that a search goes on.
BACKWARD_M, BACKWARD_FACTOR, SEARCH_M = 30.0, 1.5, 3000.0
#: Half the way round the earth; nothing is farther.
FARTHEST_M = 20_100_000.0
OPTION = ("edge_id", "offset_m", "proj_lat", "proj_lng", "distance_m")


def nearest_edges(points: DataFrame, edges: DataFrame, *, keys: list[str], first_m: float = 160.0) -> DataFrame:
    """Each point with its nearest edge (edge_id, points) at any distance: keys and the fields of OPTION.

    A hierarchy of boxes: points that find no edge within a radius go on with one four times as wide,
    in boxes of that size, so a point always looks into one box and an edge lies in few. Without
    edges there are no rows.
    """
    segments, left, found, radius = written(polyline_segments(edges.where(F.size("points") >= 2))), written(points), None, first_m
    while radius < 4 * FARTHEST_M and not left.isEmpty():
        size = max(0.001, 2 * radius / METRES_A_DEGREE)
        near = segments_within(left, segments, radius, 360.0 / max(1, int(360 / min(size, 360.0))))
        best = written(nearest_on_segments(near, keys))
        found = best if found is None else found.unionByName(best)
        left, radius = written(left.join(best, keys, "left_anti")), radius * 4
    if found is None:
        return nearest_on_segments(segments_within(points, segments, first_m, 0.001).where("false"), keys)
    return found


def widened_candidates(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` (KEY, ORDER, lat, lng, sigma) with `options`, an array of OPTION by distance, and the `step` that found them.

    radius: up to 8 edges within 2.5 deviations, but 30 to 60 m. wider: without one, those within 80
    m. projected: without one, the edges of the row before, whatever found those. nearest: without a
    row before, the nearest edge at any distance. Without any edge at all, options is null.
    """
    keys = [KEY, ORDER]
    near = near_lists(rows, polyline_segments(edges.where(F.size("points") >= 2)), keys=keys, radius=WIDER_M, k=CANDIDATES, by_edge=True)
    wide = F.when(F.size("near") > 0, F.transform("near", lambda c: F.struct(*(c[f].alias(f) for f in OPTION))))
    limit = F.least(F.lit(MOST_M), F.greatest(F.lit(LEAST_M), DEVIATIONS * F.col("sigma")))
    tight = F.filter("wide", lambda c: c["distance_m"] <= F.col("_limit"))
    found = near.withColumn("wide", wide).drop("near").withColumn("_limit", limit).withColumn("tight", tight)
    close = F.size("tight") > 0
    found = found.withColumns({"options": F.when(close, F.col("tight")).otherwise(F.col("wide")), "step": F.when(close, "radius").when(F.col("wide").isNotNull(), "wider")})
    found = written(found.withColumn("_n", F.row_number().over(along())).drop("_limit", "wide", "tight"))

    lost = nearest_edges(found.where("_n = 1 AND options IS NULL").select(*keys, "lat", "lng"), edges, keys=keys)
    begun = found.join(lost.select(*keys, F.array(F.struct(*OPTION)).alias("_first")), keys, "left")
    step = F.when(F.col("options").isNull() & F.col("_first").isNotNull(), "nearest").otherwise(F.col("step"))
    begun = begun.withColumns({"step": step, "options": F.coalesce("options", "_first")}).drop("_first")
    before = F.last("options", ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, -1))
    told = written(begun.withColumn("_before", F.when(F.col("options").isNull(), F.transform(before, lambda c: c["edge_id"]))))

    gone = told.where("options IS NULL").select(*keys, "lat", "lng", F.posexplode("_before").alias("_place", "edge_id"))
    onto = gone.join(polyline_segments(edges.where(F.size("points") >= 2)), "edge_id")
    each = nearest_on_segments(onto, [*keys, "_place"])
    again = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", *OPTION))), lambda c: F.struct(*(c[f].alias(f) for f in OPTION))).alias("_again"))
    joined = told.join(again, keys, "left")
    step = F.when(F.col("options").isNull() & F.col("_again").isNotNull(), "projected").otherwise(F.col("step"))
    return joined.withColumns({"step": step, "options": F.coalesce("options", "_again")}).drop("_again", "_before", "_n")


def kept_of_runs(rows: DataFrame, speed_kmh: float = 1.0) -> DataFrame:
    """The rows that stay when runs of slow dead-reckoning rows shrink to their last."""
    slow = F.coalesce(F.col("is_dr") & (F.coalesce("speed_kmh", F.lit(0.0)) < speed_kmh), F.lit(False))
    flagged = rows.withColumn("_slow", slow).withColumn("_goes_on", F.col("_slow") & F.coalesce(F.lead("_slow").over(along()), F.lit(False)))
    return flagged.where("NOT _goes_on").drop("_slow", "_goes_on")


def expanded_runs(rows: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """All of `rows` with `columns` of the row that stands for each in `kept`: itself or the next one there."""
    known = F.struct(*columns)
    joined = rows.join(kept.select(KEY, ORDER, known.alias("_known")), [KEY, ORDER], "left")
    back = W.partitionBy(KEY).orderBy(F.desc(ORDER)).rowsBetween(W.unboundedPreceding, W.currentRow)
    next_one = F.last("_known", ignorenulls=True).over(back)
    return joined.withColumn("_next", next_one).select(*rows.columns, *(F.col("_next")[c].alias(c) for c in columns))


def with_twins(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, from_node, to_node, oneway, points) as text ids with a reversed twin (`_rev`) of each two-way one, and their length_m."""
    columns = [F.col("edge_id").cast("string").alias("edge_id"), "from_node", "to_node", "points"]
    both = edges.select(*columns).union(edges.where(~F.coalesce("oneway", F.lit(False))).select(F.concat(F.col("edge_id").cast("string"), F.lit("_rev")), "to_node", "from_node", F.reverse("points")))
    legs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return both.where(F.size("points") >= 2).withColumn("length_m", F.aggregate(legs, F.lit(0.0), lambda s, x: s + x))


def match_adaptive(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` with matched_lat, matched_lng, edge_id and the `step` that found their candidates.

    `rows`: KEY, ORDER, t_ms, lat, lng, speed_kmh, accuracy_m, is_dr. `edges`: edge_id, from_node,
    to_node, oneway, points (array of lat, lng). Slow dead reckoning is matched by its last row, whose
    place all rows of the run get. Without edges all are null.
    """
    roads = written(with_twins(edges))
    kept = kept_of_runs(rows).select(KEY, ORDER, "t_ms", "lat", "lng", F.coalesce("speed_kmh", F.lit(0.0)).alias("speed_kmh"), "accuracy_m", F.coalesce("is_dr", F.lit(True)).alias("is_dr"))
    w = along().rowsBetween(W.unboundedPreceding, W.currentRow)
    number, fix = F.row_number().over(along()), F.last(F.when(~F.col("is_dr"), F.col("_n")), ignorenulls=True).over(w)
    counted = kept.withColumn("_n", number).withColumn("_fix", fix)
    # the first row's own step is not counted among the emissions
    counted = written(counted.withColumns({"sigma": L.adaptive_sigma(F.col("accuracy_m"), F.col("is_dr"), F.col("_n") - F.coalesce("_fix", F.lit(0))), "weight": L.adaptive_sigma(F.col("accuracy_m"), F.col("is_dr"), F.col("_n") - F.coalesce("_fix", F.lit(1)))}).drop("_n", "_fix"))
    found = widened_candidates(counted, roads.select("edge_id", "points")).where("options IS NOT NULL")
    ends = roads.select("edge_id", "from_node", "to_node", "length_m")
    about = found.select(KEY, ORDER, F.posexplode("options").alias("_place", "o")).select(KEY, ORDER, "_place", "o.*").join(ends, "edge_id")
    fields = (*OPTION, "from_node", "to_node", "length_m")
    lists = about.groupBy(KEY, ORDER).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", *fields))), lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("options"))
    found = written(found.drop("options").join(lists, [KEY, ORDER]))

    dt = F.greatest(F.lit(0.1), (F.col("t_ms") - F.col("was_t_ms")) / 1000.0)
    beta = L.dynamic_beta(F.greatest("speed_kmh", "was_speed_kmh") / 3.6, dt, F.col("is_dr") | F.col("was_is_dr"))
    p, q = F.element_at("points", 1), F.element_at("points", -1)
    graph = roads.select("from_node", "to_node", "length_m", *(x.alias(n) for n, x in (("lat1", p["lat"]), ("lng1", p["lng"]), ("lat2", q["lat"]), ("lng2", q["lng"]))))

    def weigh(route: np.ndarray, straight: np.ndarray, same: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
        moved = np.maximum(L.LEAST_LOG, -np.log(of["beta"]) - np.abs(route - straight) / of["beta"])
        return np.where(route < np.inf, moved, L.BROKEN_LOG)

    emissions = F.transform("options", lambda c: L.adaptive_emission(c["distance_m"], F.col("weight")))
    steps = weighed(found, lambda pairs: bounded_routes(graph, pairs, most=SEARCH_M), weigh, emissions=emissions, numbers_of={"beta": beta}, lagged=["t_ms", "speed_kmh", "is_dr"], radius=RADIUS_EQUATOR, backward_m=BACKWARD_M, backward_factor=BACKWARD_FACTOR)
    path = written(viterbi(steps))
    at = F.col("at")
    placed = chosen(found, path).select(KEY, ORDER, at["proj_lat"].alias("matched_lat"), at["proj_lng"].alias("matched_lng"), at["edge_id"].alias("edge_id"), "step")
    return expanded_runs(rows, placed, ["matched_lat", "matched_lng", "edge_id", "step"])
