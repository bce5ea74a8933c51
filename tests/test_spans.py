"""Span write-back against a plain version, the export's file, labelled files, datasets and graph edges."""

import json
import math
from pathlib import Path

from pyspark.sql import functions as F
from waymark.operators import matching as M
from waymark.operators import trips as T
from waymark.operators import persistence as P
from waymark.operators import roads as R
from waymark.operators import spans as S
from waymark.operators import training as D
from waymark.sources.files import V_COLUMNS, graph_edges, read_labelled, read_telemetry, read_vehicle_log

METRE = math.degrees(1 / 6371008.8)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6378137.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def verdict(rows):
    """The rule on one span's rows (is_dr, raw, matched), written plainly."""
    if len(rows) < 2 or rows[-1][0]:
        return "kept"
    raw, moved = [r[1] for r in rows], [r[2] for r in rows]
    n = len(rows)
    before, after = metres(raw[n - 2], raw[n - 1]), metres(moved[n - 2], raw[n - 1])
    way, left = (sum(metres(p[i - 1], p[i]) for i in range(1, n - 1)) for p in (raw, moved))
    if after > before + 1:
        return "worse endpoint"
    return "lost progress" if way > 5 and left / way < 0.7 else "kept"


def test_matched_spans_written_back(spark):
    # a straight road to the east; the second span heads north, away from it, so its match loses the way
    plan = [(0, 0, False), (20, 3, True), (40, -4, True), (60, 2, False), (61, 10, True), (61, 25, True), (61, 40, True), (61, 55, False), (61, 60, True)]
    rows = [("a", i + 1, y * METRE, x * METRE, 5.0, dr) for i, (x, y, dr) in enumerate(plan)]
    points = spark.createDataFrame(rows, "session_id string, seq long, lat double, lng double, accuracy_m double, is_dr boolean")
    edges = spark.createDataFrame([(1, 1, 2, 0.0, -100 * METRE, 0.0, 200 * METRE)], "edge_id long, from_node long, to_node long, lat1 double, lng1 double, lat2 double, lng2 double")
    found = S.matched_spans(points, edges, points["is_dr"])
    parts = {}
    for r in found.orderBy("span", "seq").collect():
        parts.setdefault(r["span"], []).append((r["is_dr"], (r["lat"], r["lng"]), (r["matched_lat"], r["matched_lng"])))
        assert abs(r["matched_lat"]) < 1e-9 or r["lat"] > 50 * METRE
    verdicts = {r["span"]: r["verdict"] for r in S.span_verdicts(found).collect()}
    assert verdicts == {k: verdict(v) for k, v in parts.items()}
    assert verdicts[1] == "kept" and verdicts[2] != "kept" and len(verdicts) == 3
    done = {r["seq"]: r for r in S.written_back(points, found, S.span_verdicts(found)).collect()}
    assert len(done) == len(plan)
    assert done[2]["matched_lat"] is not None and done[4]["matched_lat"] is None and done[5]["matched_lat"] is None
    assert (done[5]["span"], done[5]["verdict"], done[1]["verdict"]) == (2, verdicts[2], None)


def test_fallback_after_rejection(spark):
    points = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.1)], "session_id string, seq long, lat double, lng double")
    matched = spark.createDataFrame([("a", 1, 5.0, 6.0), ("a", 2, None, None)], "session_id string, seq long, matched_lat double, matched_lng double")
    nodes = spark.createDataFrame([("a", 1, 7.0, 7.0)], "session_id string, seq long, node_lat double, node_lng double")
    got = {r["seq"]: (r["final_lat"], r["source"]) for r in M.with_fallback(points, matched, nodes).collect()}
    assert got == {1: (5.0, "match"), 2: (1.0, "raw")}


def test_empty_tables(spark):
    points = spark.createDataFrame([], "session_id string, seq long, lat double, lng double, accuracy_m double, is_dr boolean")
    parts = S.span_rows(points, points["is_dr"])
    lines = spark.createDataFrame([(1, [(0.0, 0.0)]), (2, [])], "edge_id long, points array<struct<lat: double, lng: double>>")
    assert parts.count() == 0 and R.polyline_candidates(points, lines, keys=["session_id", "seq"]).count() == 0


def test_export_file_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1759084728384, "a", 2, 17.5, 75.25, None, 0.4, True), (1759084728383, "a", 1, 17.0, 75.0, 3.0, 9.0, False)], "t_ms long, session_id string, seq long, lat double, lng double, accuracy_m double, speed_kmh double, is_dr boolean")
    path = str(tmp_path / "out")
    P.write_telemetry_export(rows, path, origin="Here", distance_km=1.5)
    (part,) = Path(path).glob("part-*")
    lines = part.read_bytes().decode().split("\r\n")
    assert lines[:2] == ["# Origin: Here", "# Distance: 1.5 km"] and lines[-1] == ""
    assert [len(x.split(",")) for x in lines[2:5]] == [33, 33, 33] and len(lines) == 6
    assert lines[3].startswith("1759084728383,2025-09-28T18:38:48.383Z,GNSS,17.000000,75.000000,3.0,9.0,,,FALSE,") and ",RELEASED,FALSE," in lines[3]
    back = {r["row"]: r for r in read_telemetry(spark, path).collect()}
    assert (back[0]["Latitude"], back[0]["Is_Dead_Reckoning"], back[1]["Accuracy_Meters"], back[1]["ZUPT_State"]) == (17.0, False, 15.0, "LOCKED")


def test_labelled_files_and_dataset(spark, tmp_path):
    for name, n in (("b", 3), ("a", 25)):
        (tmp_path / f"{name}_labeled.csv").write_text("x,err\n" + "".join(f"{i},{i / 10}\n" for i in range(n)))
    (tmp_path / "other.csv").write_text("x,err\n1,1\n")
    rows = read_labelled(spark, str(tmp_path))
    assert {(r["session_id"], r["n"]) for r in rows.groupBy("session_id").agg({"seq": "max"}).toDF("session_id", "n").collect()} == {("a", 25), ("b", 3)}
    assert sorted((r["seq"], r["x"]) for r in rows.where("session_id = 'b'").collect()) == [(1, 0.0), (2, 1.0), (3, 2.0)]
    D.write_dataset(D.training_windows(rows, ["x"], ["x"], ["err"]), str(tmp_path / "set"))
    assert [(r["session_id"], r["n_windows"]) for r in spark.read.parquet(str(tmp_path / "set" / "sessions")).collect()] == [("a", 1)]
    (manifest,) = (json.loads(p.read_text()) for p in (tmp_path / "set" / "manifest").glob("part-*") if p.stat().st_size)
    assert manifest == {"total_windows": 1, "clip_threshold": 50.0, "window_size": 20, "stride": 5}
    P.write_labelled(rows, str(tmp_path / "out"))
    again = read_labelled(spark, str(tmp_path / "out"))
    assert sorted((r["session_id"], r["seq"], r["x"], r["err"]) for r in again.collect()) == sorted((r["session_id"], r["seq"], r["x"], r["err"]) for r in rows.collect())
    odd = rows.where("session_id = 'b'").withColumn("session_id", F.lit("trip 1/2 é"))
    P.write_labelled(odd, str(tmp_path / "odd"))
    assert {r["session_id"] for r in read_labelled(spark, str(tmp_path / "odd")).collect()} == {"trip 1/2 é"}


def test_files_of_different_headers_in_one_folder(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("Latitude,Longitude,Speed_KmH\n1,2,3\n")
    (tmp_path / "b.csv").write_text("# Origin: Here\nSpeed_KmH,Latitude,Longitude,Source_Type\n30,10,20,GNSS\n,11,21,\n")
    rows = sorted((r["Latitude"], r["Longitude"], r["Speed_KmH"], r["Source_Type"], r["row"]) for r in read_telemetry(spark, str(tmp_path)).collect())
    assert rows == [(1.0, 2.0, 3.0, None, 0), (10.0, 20.0, 30.0, "GNSS", 0), (11.0, 21.0, 0.0, None, 1)]
    (tmp_path / "logs").mkdir()
    for name, header in (("V-1", "Latitude (degrees),Velocity (km/hr)"), ("V-2", "Velocity (km/hr),Latitude (degrees)")):
        (tmp_path / "logs" / f"{name}.csv").write_text(f"{header}\n5,6\n")
    logs = read_vehicle_log(spark, str(tmp_path / "logs")).collect()
    assert sorted((r["lat"], r["speed"]) for r in logs) == [(5.0, 6.0), (6.0, 5.0)]
    (tmp_path / "x_labeled.csv").write_text("p,q\n1,2\n")
    (tmp_path / "y_labeled.csv").write_text("q,p,r\n1,2,3\n")
    assert sorted((r["p"], r["q"], r["r"]) for r in read_labelled(spark, str(tmp_path)).collect()) == [(1.0, 2.0, None), (2.0, 1.0, 3.0)]


def test_truth_of_one_time_is_one_row_and_clocks_start_above_zero(spark):
    samples = spark.createDataFrame([(1, 1, 5.0)], "session_id long, seq long, t double")
    truth = spark.createDataFrame([(1, 5.0, 2.0, 3.0), (1, 5.0, 1.0, 9.0)], "session_id long, t double, x double, y double")
    (row,) = T.interpolated(samples, truth, "t", ["x", "y"]).collect()
    assert (row["true_x"], row["true_y"]) == (1.0, 9.0)
    clock = spark.createDataFrame([(1, i, t, 1.0 * i) for i, t in enumerate([-100, 50_000, 40_000, 40_001, 90_000], 1)], "session_id long, seq long, t_ms long, x double")
    found = {r["seq"]: r["clock"] for r in T.imu_anomalies(clock, ["x"]).collect()}
    assert found == {1: False, 2: False, 3: True, 4: False, 5: True}


def test_vehicle_log(spark, tmp_path):
    (tmp_path / "V-1.csv").write_text(",".join(V_COLUMNS.values()) + "\n" + ",".join(str(i) for i in range(len(V_COLUMNS))) + "\n")
    (row,) = read_vehicle_log(spark, str(tmp_path / "V-1.csv")).collect()
    assert (row["time"], row["lat"], row["gps_sats"], row["seq"]) == (0.0, 1.0, 16.0, 1)


def test_graph_edges_take_first_of_lists(spark):
    edges = spark.createDataFrame([(1, 2, 0, "[11, 12]", '["A", "B"]', True), (1, 2, 1, "13", '"C"', None), (2, 1, 0, None, None, False), (2, 9, 0, "1", "x", False)], "u long, v long, key int, osmid string, name string, oneway boolean")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "node_id long, lat double, lng double")
    got = sorted((r["edge_id"], r["name"], r["oneway"]) for r in graph_edges(edges, nodes).collect())
    assert got == [("11", "A", True), ("13", "C", False), ("2_1_0", "", False)]
