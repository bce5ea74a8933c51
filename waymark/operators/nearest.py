"""The nearest segments of points that came together with the segments of their bucket, many points at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from waymark.functions import geodesy as G

METRES_A_DEGREE = G.RADIUS_MEAN * 3.141592653589793 / 180
#: Points whose pairs are worked on together.
POINTS = 1000
#: What is measured of a pair, in the order of the elements.
MEASURES = ("share", "distance_m", "length_m", "offset_m", "proj_lat", "proj_lng")
#: Metres that a radian of turn counts as.
METRES_A_RADIAN = 10.0


def nearest(looked: DataFrame, keep: list[str], *, radius: float, k: int, by_edge: bool = False, gate: float | None = None) -> DataFrame:
    """Columns `keep` and `near` of rows with lat, lng, _east (metres of a degree of longitude) and _segments, as `near_lists` has it.

    With `gate`, rows have `_asked` and segments `_along`, in degrees: segments that differ by more are
    left out, either way along unless `oneway`, and the difference is added to the distance; a null
    `_asked` asks for nothing.
    """
    element = looked.schema["_segments"].dataType.elementType
    first = ["edge_id", "leg"] if by_edge else ["edge_id"]
    carried = [*first, *(f.name for f in element.fields if f.name not in first)]
    kinds = [StructField("_cost", DoubleType()), *(element[c] for c in carried), *(StructField(c, DoubleType()) for c in MEASURES)]
    schema = StructType([*(looked.schema[c] for c in keep), StructField("near", ArrayType(StructType(kinds)))])
    turning = ["_asked"] if gate is not None else []
    own = [*dict.fromkeys([*keep, "lat", "lng", "_east", *turning])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POINTS):
                part = batch.slice(at, POINTS)
                near = _lists(part, carried, radius, k, by_edge, gate)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), near], names=[*keep, "near"])

    return looked.select(*own, "_segments").mapInArrow(run, schema)


def _lists(points: pa.RecordBatch, carried: list[str], radius: float, k: int, by_edge: bool, gate: float | None) -> pa.ListArray:
    lists = points.column("_segments")
    segments = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    ends = {c: numbers(segments.field(c)) for c in ("lat1", "lng1", "lat2", "lng2")}
    lat, lng, east = (numbers(points.column(c)) for c in ("lat", "lng", "_east"))

    # what is too far north or south needs no geometry
    high = radius / METRES_A_DEGREE + 1e-9
    level = (lat[row] >= np.minimum(ends["lat1"], ends["lat2"]) - high) & (lat[row] <= np.maximum(ends["lat1"], ends["lat2"]) + high)
    which = np.nonzero(level)[0]
    row, ends = row[which], {c: x[which] for c, x in ends.items()}
    with np.errstate(all="ignore"):
        ax, bx = (_short_way(ends[f"lng{i}"] - lng[row]) * east[row] for i in (1, 2))
        ay, by = ((ends[f"lat{i}"] - lat[row]) * METRES_A_DEGREE for i in (1, 2))
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        share = np.where(square <= 1e-12, 0.0, np.maximum(0.0, np.minimum(1.0, ((0.0 - ax) * dx + (0.0 - ay) * dy) / square)))
        x, y = ax + share * dx, ay + share * dy
        distance, length = np.sqrt(x * x + y * y), np.sqrt(square)
    cost, within = distance, distance <= radius
    if gate is not None:
        more = _turns(points, segments, row, which, gate)
        cost, within = distance + more, within & ~np.isnan(more)
    kept = np.nonzero(within)[0]
    row, which, share, distance, length, cost = (v[kept] for v in (row, which, share, distance, length, _micrometres(cost)))
    ends = {c: v[kept] for c, v in ends.items()}

    edge = ids_as_ranks(segments.field("edge_id").take(pa.array(which)))
    keys = [edge, cost, row]
    if by_edge:
        keys.insert(0, numbers(segments.field("leg"))[which])
    order = np.lexsort(keys)
    if by_edge:
        # an edge counts by the first of its segments
        grouped = np.lexsort((edge[order], row[order]))
        new = np.ones(len(order), bool)
        new[1:] = (edge[order][grouped][1:] != edge[order][grouped][:-1]) | (row[order][grouped][1:] != row[order][grouped][:-1])
        order = order[np.sort(grouped[new])]
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    order = order[place < k]

    row, which, share, distance, length, cost = (v[order] for v in (row, which, share, distance, length, cost))
    ends = {c: v[order] for c, v in ends.items()}
    at = pa.array(which)
    given = [segments.field(c).take(at) for c in carried]
    offset = share * length
    if by_edge:
        offset = numbers(given[carried.index("before_m")]) + offset
    there = [ends[f"{c}1"] + share * (ends[f"{c}2"] - ends[f"{c}1"]) for c in ("lat", "lng")]
    elements = pa.StructArray.from_arrays([pa.array(cost), *given, *map(pa.array, (share, distance, length, offset, *there))], names=["_cost", *carried, *MEASURES])
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lists)))))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), elements)


def numbers(column: pa.Array) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def _short_way(degrees: np.ndarray) -> np.ndarray:
    """A difference of longitudes, across the 180th degree where that is shorter."""
    return np.where(degrees > 180, degrees - 360, np.where(degrees < -180, degrees + 360, degrees))


def _micrometres(metres: np.ndarray) -> np.ndarray:
    """Metres rounded to six places, halves up."""
    scaled = metres * 1e6
    below = np.floor(scaled)
    return (below + (scaled - below >= 0.5)) / 1e6


def _turns(points: pa.RecordBatch, segments: pa.StructArray, row: np.ndarray, which: np.ndarray, gate: float) -> np.ndarray:
    """Metres that the turn of each pair counts as; no number beyond the gate."""
    asked = points.column("_asked")
    free = asked.is_null().to_numpy(zero_copy_only=False)[row]
    rest = np.fmod(numbers(segments.field("_along"))[which] - numbers(asked)[row] + 180, 360.0)
    forth = np.abs(np.where(rest < 0, np.fmod(rest + 360, 360.0), rest) - 180)
    turn = np.minimum(forth, 180 - forth)
    if any(f.name == "oneway" for f in segments.type):
        turn = np.where(pc.fill_null(segments.field("oneway"), False).to_numpy(zero_copy_only=False)[which], forth, turn)
    return np.where(free, 0.0, np.where(turn <= gate, np.radians(turn) * METRES_A_RADIAN, np.nan))


def ids_as_ranks(ids: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the ids, nulls first; equal ids have equal ones."""
    if pa.types.is_integer(ids.type) and ids.null_count == 0:
        return ids.to_numpy(zero_copy_only=False)
    coded = ids.dictionary_encode()
    ranks = np.empty(len(coded.dictionary) + 1, np.int64)
    ranks[pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(coded.dictionary))
    ranks[-1] = -1
    return ranks[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]
