"""Estimators, matching, readers and windows on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geodesy as G
from waymark.operators import estimators as E
from waymark.operators import matching as M
from waymark.operators import roads as R
from waymark.operators import training as D
from waymark.operators import trips as T
from waymark.sources import files as S


def test_cell_key_and_projection(spark):
    row = spark.range(1).select(G.cell_key(F.lit(17.659920), F.lit(75.906410)).alias("k"), G.project_metres(F.lit(17.6550), F.lit(75.9005), F.lit(17.65), F.lit(75.90), F.lit(17.66), F.lit(75.90), G.RADIUS_EQUATOR)[1].alias("m")).first()
    assert row["k"] == "706_3036"
    assert row["m"] == pytest.approx(53.04, abs=0.01)


def test_unwrap_restarts(spark):
    rows = spark.createDataFrame([(1, 1, 4900), (1, 2, 5000), (1, 3, 100), (1, 4, 200)], "session_id int, seq int, t int")
    assert [r["u"] for r in T.unwrapped(rows, "t", "u").orderBy("seq").collect()] == [4900, 5000, 5100, 5200]


@pytest.mark.parametrize(("n", "ends"), [(19, []), (20, []), (25, [20]), (26, [20, 25])])
def test_training_windows_leave_out_the_last_row(spark, n, ends):
    rows = spark.range(1, n + 1).select(F.lit(1).alias("session_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("x"), F.lit(50.0).alias("e"))
    assert sorted(r["end_row"] for r in D.training_windows(rows, ["x"], ["x"], ["e"]).collect()) == ends


def test_training_windows_drop_large_errors(spark):
    rows = spark.range(1, 40).select(F.lit(1).alias("session_id"), F.col("id").alias("seq"), F.lit(float("nan")).alias("x"), F.lit(50.1).alias("e"))
    assert D.training_windows(rows, ["x"], ["x"], ["e"]).count() == 0


def test_quality_machine_needs_time_to_change():
    machine = E.QualityMachine()
    assert [machine.step(True, 20.0)[0] for _ in range(5)] == ["GOOD"] * 4 + ["DEGRADED"]
    assert [machine.step(False, None)[0] for _ in range(10)] == ["DEGRADED"] * 9 + ["LOST"]
    modes = [machine.step(True, 3.0)[0] for _ in range(20)]
    assert modes == ["RECOVERING"] * 19 + ["GOOD"]


def test_filter_stays_symmetric_and_positive():
    ekf, rng = E.Ekf(), np.random.default_rng(0)
    for i in range(200):
        ekf.predict(0.1, accel=rng.normal([0, 0, 9.8], 0.3), gyro=rng.normal(0, 0.02, 3))
        if i % 10 == 0:
            ekf.update_gnss(rng.normal(0, 3, 2), 5.0)
            ekf.update_no_side_slip()
    assert np.allclose(ekf.P, ekf.P.T)
    assert np.linalg.eigvalsh(ekf.P).min() > 0
    ekf.update_rest()
    assert not ekf.velocity.any()


def test_filter_gate_and_reset_on_the_fifth_rejection():
    driver = E.FusionDriver()
    driver.step(0.0, 0.0, 0.0, 0.0, 0.0, True, 3.0, 8.0, None, None)
    far = [driver.step(0.1 * i, 0.0, 0.0, 9000.0, 0.0, True, 3.0, 8.0, None, None)[0] for i in range(1, 6)]
    assert max(far[:4]) < 100
    assert far[4] == 9000.0


def test_rate_limiter_holds_the_speed():
    limiter = E.RateLimiter()
    limiter.step(0, 10.0, 20.0)
    lat, lng, clamped = limiter.step(1000, 10.01, 20.0)
    assert clamped
    assert E.distance_and_bearing(10.0, 20.0, lat, lng)[0] == pytest.approx(33.3, abs=0.01)
    assert limiter.step(20000, 11.0, 20.0) == (11.0, 20.0, False)


def test_smoother_keeps_a_still_position():
    smoother = E.Smoother()
    for i in range(50):
        lat, lng, _ = smoother.step(1000.0 * (i + 1), 10.0, 20.0, "GOOD")
    assert (lat, lng) == (pytest.approx(10.0, abs=1e-9), pytest.approx(20.0, abs=1e-9))


LAT0, LNG0 = 51.7520, -1.2577


def place(x, y):
    return LAT0 + math.degrees(y / G.RADIUS_MEAN), LNG0 + math.degrees(x / (G.RADIUS_MEAN * math.cos(math.radians(LAT0))))


def matched(spark, edges, seen, **options):
    rows = []
    for k, (x1, y1, x2, y2, oneway) in enumerate(edges):
        (a, b), (c, d) = place(x1, y1), place(x2, y2)
        rows.append((k, 2 * k, 2 * k + 1, a, b, c, d, oneway))
    roads = spark.createDataFrame(rows, "edge_id long, from_node long, to_node long, lat1 double, lng1 double, lat2 double, lng2 double, oneway boolean")
    points = spark.createDataFrame([(1, i + 1, *place(x, y), acc) for i, (x, y, acc) in enumerate(seen)], "session_id long, seq long, lat double, lng double, accuracy_m double")
    return M.match(points, roads, **options).orderBy("seq").collect()


def test_matching_follows_a_straight_road(spark):
    found = matched(spark, [(0, 0, 500, 0, False)], [(x, 0, None) for x in (50, 100, 150, 200, 250)])
    assert [r["edge_id"] for r in found] == [0] * 5


def test_matching_takes_noise_out(spark):
    found = matched(spark, [(0, 0, 300, 0, False)], [(20, 10, 5.0), (80, -8, 5.0), (140, 12, 5.0), (200, -9, 5.0), (260, 7, 5.0)], sigma=5.0)
    assert all(abs(r["matched_lat"] - LAT0) < 5e-6 for r in found)


def test_matching_stays_on_the_highway(spark):
    found = matched(spark, [(0, 0, 400, 0, True), (50, 15, 100, 15, True)], [(25, 1, None), (75, 11, None), (150, 0.5, None), (225, -1, None), (300, 0, None)], sigma=5.0, beta=5.0, radius=30.0)
    assert [r["edge_id"] for r in found] == [0] * 5


def test_matching_leaves_the_roads(spark):
    found = matched(spark, [(0, 0, 100, 0, False)], [(20, 0, None), (20, 0, None), (50, 0, None), (500, 500, None)], radius=30.0)
    assert [r["edge_id"] for r in found] == [0, 0, 0, None]


def test_resolver():
    columns = [" ACCELEROMETER X (m/s²) ", "GRAVITY X (m/s²)", "my time since"]
    assert S.resolve(columns, "accelerometer x") == columns[0]
    assert S.resolve(columns, "TIME SINCE") == columns[2]
    with pytest.raises(KeyError):
        S.resolve(columns, "wheel")


def test_phone_log(spark, tmp_path):
    (tmp_path / "S-1.csv").write_bytes("TIME SINCE START (ms), ACCELEROMETER X (m/s²) \n4900,1\n5000,2\n100,\n".encode("iso-8859-1"))
    rows = S.read_phone_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["time"] for r in rows] == [4900, 5000, 5100]
    assert [r["acc_x"] for r in rows] == [1, 2, None]


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# one\n# two\nTimestamp_Epoch_Ms,Latitude,Longitude,Accuracy_Meters,Speed_KmH,Heading_Deg,Is_Dead_Reckoning\n1,10.5,20.5,,3.5,,TRUE\n2,,20.5,1,1,1,FALSE\n3,11.5,21.5,7,,9,FALSE\n")
    rows = S.read_telemetry(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["row"], r["Timestamp_Epoch_Ms"], r["Accuracy_Meters"], r["Speed_KmH"], r["Heading_Deg"], r["Is_Dead_Reckoning"]) for r in rows] == [(0, 1, 15.0, 3.5, 0.0, True), (1, 3, 7.0, 0.0, 9.0, False)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node")).union(spark.createDataFrame([(100, 101)], "a long, b long"))
    found = {r["node_id"]: r["component"] for r in R.components(edges).collect()}
    assert set(found.values()) == {0, 100}
    assert found[60] == 0


def test_fold_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).select((F.col("id") % 2).alias("session_id"), F.col("id").alias("seq"), (F.col("id") * 500.0).alias("t"))
        kept = E.fold(rows, lambda: E.Thinning(2000), ["t"], E.Thinning.OUTPUTS).where("emitted").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept == 50
