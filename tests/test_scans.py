"""Scans and successor graphs against loops over rows, with sessions split over many tasks."""

import random

import pytest
from waymark.operators import estimators as E
from waymark.operators import scans as C


@pytest.fixture(params=[1, 7])
def many_tasks(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sessions(rng):
    """One session of most rows, some of one row, one without a key."""
    return [(1, 300), (2, 1), (3, 40), (4, 1), (5, 25), (None, 17)]


def test_filter_splits_a_session(spark, many_tasks):
    rng, rows, wanted = random.Random(1), [], {}
    for key, n in sessions(rng):
        y = None
        for seq in range(1, n + 1):
            x = rng.uniform(-50, 50)
            y = x if y is None else y + 0.2 * (x - y)
            rows.append((key, seq, x))
            wanted[key, seq] = y
    rng.shuffle(rows)
    found = C.scanned(spark.createDataFrame(rows, "session_id long, seq long, x double"), C.Ema(0.2), ["x"]).collect()
    assert len(found) == len(wanted)
    assert all(abs(r["filtered"] - wanted[r["session_id"], r["seq"]]) < 1e-9 for r in found)


def test_modes_split_a_session(spark, many_tasks):
    rng, rows, wanted = random.Random(2), [], {}
    for key, n in sessions(rng):
        machine, seq = E.QualityMachine(), 0
        while seq < n:
            kind = rng.choice([3.0, 20.0, None, 60.0, 12.0])
            for _ in range(min(n - seq, rng.choice([1, 3, 6, 12, 25, 40]))):
                seq += 1
                sats = rng.choice([None, 8.0])
                rows.append((key, seq, kind is not None, kind, sats))
                wanted[key, seq] = machine.step(kind is not None, kind, sats)
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "session_id long, seq long, ok boolean, accuracy double, sats double")
    found = C.quality_modes(frame, F.col("ok"), F.col("accuracy"), F.col("sats")).collect()
    assert {w[0] for w in wanted.values()} == {"GOOD", "DEGRADED", "LOST", "RECOVERING"}
    for r in found:
        mode, score, trust, active, skip = wanted[r["session_id"], r["seq"]]
        assert (r["mode"], r["ai_active"], r["skip_gnss"]) == (mode, active, skip)
        assert abs(r["score"] - score) < 1e-12 and abs(r["trust"] - trust) < 1e-12
    assert len(found) == len(wanted)


def test_thinning_with_a_clock_that_jumps(spark):
    rng, rows, wanted = random.Random(3), [], {}
    for key, n in sessions(rng):
        thin, t = E.Thinning(100), 0
        for seq in range(1, n + 1):
            t += rng.choice([0, 10, 60, 100, 250, -80])
            rows.append((key, seq, t))
            wanted[key, seq] = thin.step(t)[0]
    frame = spark.createDataFrame([*rows, (9, 1, None), (9, 2, 5)], "session_id long, seq long, t_ms long")
    found = {(r["session_id"], r["seq"]): r["emitted"] for r in C.thinned(frame, "t_ms", 100).collect()}
    assert found == wanted | {(9, 1): False, (9, 2): True}
    assert C.thinned(frame.where("false"), "t_ms", 100).count() == 0


def test_resets_like_a_loop(spark):
    from pyspark.sql import functions as F

    rng, rows, wanted = random.Random(4), [], {}
    for key, n in sessions(rng):
        t, mine = 0.0, []
        for seq in range(1, n + 1):
            t += rng.choice([0.5, 1.0, 4.0, 30.0])
            mine.append((key, seq, t, rng.random() < 0.7, rng.choice([2.0, 10.0, 25.0])))
        resets, last = set(), 0
        for i in range(1, n):
            if mine[i][2] - mine[last][2] > mine[last][4] and mine[i - 1][3]:
                last = i - 1
                resets.add(last)
        rows += mine
        wanted |= {(key, m[1]): i in resets for i, m in enumerate(mine)}
    frame = spark.createDataFrame(rows, "session_id long, seq long, t double, fix boolean, every double")
    found = {(r["session_id"], r["seq"]): r["is_reset"] for r in C.reanchored(frame, "t", F.col("every"), F.col("fix")).collect()}
    assert found == wanted and any(wanted.values())
