"""Hidden-Markov map matching as joins and one streaming max-plus pass.

Candidates come from a spatial join, moves from the candidates of neighbouring rows, and the
lengths between them from the overlay of `routes`; no task holds the road graph. What is left for a
session is a product of small matrices in order: rows stream through sorted partitions, and the path
is settled as far back as all survivors share it, so a session of any length needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.checkpoints import written
from waymark.functions.geodesy import RADIUS_MEAN, haversine
from waymark.functions.labels import emission
from waymark.operators.moves import weighed
from waymark.operators.roads import near_lists
from waymark.operators.routes import shortest
from waymark.operators.trips import KEY, ORDER

# Fixed values of the model: log penalty of a broken path, metres of tolerated backward motion, its factor.
BROKEN, BACKWARD_M, BACKWARD_FACTOR = -50.0, 25.0, 1.5
#: Fields of a candidate; off the roads edge_id is null.
CANDIDATE = ("edge_id", "from_node", "to_node", "oneway", "length_m", "offset_m", "proj_lat", "proj_lng", "distance_m")


class Survivors:
    """Back pointers of the rows whose choice is still open."""

    def __init__(self, first: int):
        self.rows: list[tuple[int, np.ndarray | None]] = [(first, None)]
        self.look = 64

    def add(self, row: int, back: np.ndarray) -> list[tuple[int, int]]:
        """Rows (and their choice) that this one settles: those before the last row that all survivors share."""
        self.rows.append((row, back))
        if len(self.rows) < self.look:
            return []
        alive = np.arange(len(back))
        for at in range(len(self.rows) - 1, 0, -1):
            alive = np.unique(self.rows[at][1][alive])
            if len(alive) == 1:
                found = self.path(int(alive[0]), at - 1)
                self.rows = [(self.rows[at][0], None), *self.rows[at + 1 :]]
                self.look = 64
                return found
        self.look = 2 * len(self.rows)
        return []

    def path(self, choice: int, at: int) -> list[tuple[int, int]]:
        """Rows up to place `at` with their choice, from the choice there."""
        found = [(self.rows[at][0], choice)]
        for k in range(at, 0, -1):
            choice = int(self.rows[k][1][choice])
            found.append((self.rows[k - 1][0], choice))
        return found[::-1]


def viterbi(steps: DataFrame) -> DataFrame:
    """Most likely candidate of each row: KEY, ORDER, choice (from 0), of (KEY, ORDER, emissions, moves).

    `moves` has the log weight from each candidate of the row before to each of this one, that of
    the row before first; null on a session's first row. Of equal scores the first candidate wins. A
    last row of each session, ORDER null, has the score of the whole path in `total` and its rows in `n`.
    """
    kind = steps.schema[KEY].dataType.simpleString()
    narrow = steps.select(KEY, ORDER, "emissions", "moves").repartition(KEY).sortWithinPartitions(KEY, ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        out: list[tuple] = []
        session, open_rows, scores, n = object(), None, None, 0

        def ended() -> None:
            best = int(np.argmax(scores))
            rows = open_rows.path(best, len(open_rows.rows) - 1)
            out.extend((session, row, choice, None, None) for row, choice in rows)
            out.append((session, None, None, float(scores[best]), n))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[KEY, ORDER, "choice", "total", "n"])

        for batch in batches:
            schema = [batch.column(0).type, pa.int64(), pa.int32(), pa.float64(), pa.int64()]
            emissions, moves = batch.column(2), batch.column(3)
            for i, (key, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                here = emissions[i].values.to_numpy()
                if open_rows is None or key != session:
                    if open_rows is not None:
                        ended()
                    session, open_rows, scores, n = key, Survivors(row), here, 1
                    continue
                reached = scores[:, None] + moves[i].values.to_numpy().reshape(len(scores), len(here))
                back = np.argmax(reached, axis=0)
                scores, n = reached[back, np.arange(len(here))] + here, n + 1
                out.extend((session, at, choice, None, None) for at, choice in open_rows.add(row, back))
            yield flushed()
        if open_rows is not None:
            ended()
            yield flushed()

    return narrow.mapInArrow(run, f"{KEY} {kind}, {ORDER} long, choice int, total double, n long")


def chosen(rows: DataFrame, path: DataFrame) -> DataFrame:
    """`rows` with their chosen option as `at`."""
    return rows.join(path.where("choice IS NOT NULL").select(KEY, ORDER, "choice"), [KEY, ORDER]).withColumn("at", F.get("options", F.col("choice"))).drop("choice")


def match(points: DataFrame, edges: DataFrame, *, sigma: float = 4.07, beta: float = 5.0, radius: float = 50.0, k: int = 5, most_route: float | None = None) -> DataFrame:
    """session_id, seq, matched_lat, matched_lng, edge_id (null off the roads) and the session's confidence.

    `points` has lat, lng and accuracy_m; `edges` has edge_id, from_node, to_node, lat1, lng1, lat2,
    lng2 and optionally oneway, one row for each direction of travel with the two-way flag false on
    both. Only nodes that no route joins count as broken, unless `most_route` metres bound the routes.
    """
    flagged = edges if "oneway" in edges.columns else edges.withColumn("oneway", F.lit(False))
    known = F.when(~F.isnan("accuracy_m"), F.col("accuracy_m")).alias("accuracy_m")
    fields = [c for c in CANDIDATE if c in flagged.columns]
    found = near_lists(points.select(KEY, ORDER, "lat", "lng", known), flagged.select(*fields, "lat1", "lng1", "lat2", "lng2"), keys=[KEY, ORDER], radius=radius, k=k)
    near = F.transform("near", lambda c: F.struct(*(c[f].alias(f) for f in CANDIDATE)))
    found = found.withColumn("near", near)
    kinds = {f.name: f.dataType for f in found.schema["near"].dataType.elementType.fields}
    alone = {"oneway": F.lit(True), "length_m": F.lit(0.0), "offset_m": F.lit(0.0), "proj_lat": F.col("lat"), "proj_lng": F.col("lng"), "distance_m": F.lit(0.0)}
    off_road = F.array(F.struct(*(alone.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in CANDIDATE)))
    rows = found.withColumn("options", F.when(F.size("near") > 0, F.col("near")).otherwise(off_road)).drop("near")
    rows = written(rows)

    length = haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"), RADIUS_MEAN)
    roads = flagged.withColumn("length_m", length)
    still = haversine(F.col("was_lat"), F.col("was_lng"), F.col("lat"), F.col("lng"), RADIUS_MEAN) < 0.5

    def weigh(route: np.ndarray, straight: np.ndarray, same: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
        moved = np.where(np.isnan(route), BROKEN, -np.log(beta) - np.abs(route - straight) / beta)
        return np.where(same & (of["still"] == 1), 0.0, moved)

    emissions = F.transform("options", lambda c: emission(c["distance_m"], F.col("accuracy_m"), sigma))
    steps = weighed(rows, lambda pairs: shortest(roads, pairs, most=most_route), weigh, emissions=emissions, numbers_of={"still": still}, lagged=["lat", "lng"], radius=RADIUS_MEAN, backward_m=BACKWARD_M, backward_factor=BACKWARD_FACTOR, two_way=True, same_edge=True)
    path = written(viterbi(steps))
    sure = path.where("total IS NOT NULL").select(KEY, F.least(F.lit(1.0), F.exp(F.col("total") / F.col("n") / 10)).alias("confidence"))
    at = F.col("at")
    return chosen(rows, path).join(sure, KEY).select(KEY, ORDER, at["proj_lat"].alias("matched_lat"), at["proj_lng"].alias("matched_lng"), at["edge_id"].alias("edge_id"), "confidence")


def do_no_harm(spans: DataFrame, *, tolerance_m: float = 1.0, least_ratio: float = 0.7, least_m: float = 5.0) -> DataFrame:
    """Whether the match of a span is kept: (raw_error_m, matched_error_m, raw_progress_m, matched_progress_m, anchored).

    Judged only where the last point is an anchor; rejected if the end is worse by more than the
    tolerance, or too little of the raw way is left.
    """
    worse = F.col("matched_error_m") > F.col("raw_error_m") + tolerance_m
    short = (F.col("raw_progress_m") > least_m) & (F.col("matched_progress_m") < least_ratio * F.col("raw_progress_m"))
    verdict: Column = F.when(~F.col("anchored"), "kept").when(worse, "worse endpoint").when(short, "lost progress").otherwise("kept")
    return spans.withColumn("verdict", verdict)


def with_fallback(points: DataFrame, matched: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Positions by the first source that has one: the match, the nearest node, the raw point."""
    joined = points.join(matched.select(KEY, ORDER, "matched_lat", "matched_lng"), [KEY, ORDER], "left")
    lat, lng, source = [F.col("matched_lat")], [F.col("matched_lng")], F.when(F.col("matched_lat").isNotNull(), "match")
    if nodes is not None:
        joined = joined.join(nodes.select(KEY, ORDER, "node_lat", "node_lng"), [KEY, ORDER], "left")
        lat, lng, source = [*lat, F.col("node_lat")], [*lng, F.col("node_lng")], source.when(F.col("node_lat").isNotNull(), "node")
    return joined.select(*points.columns, F.coalesce(*lat, F.col("lat")).alias("final_lat"), F.coalesce(*lng, F.col("lng")).alias("final_lng"), source.otherwise("raw").alias("source"))
