"""Rows of many sessions at once give what each session gives alone, and need fewer steps."""

import random

import numpy as np
import pytest

from waymark.operators import estimators as E

INPUTS = ["t", "ins_x", "ins_y", "fix_x", "fix_y", "available", "accuracy", "sats", "ai_x", "ai_y"]
KINDS = "session_id long, seq long, t double, ins_x double, ins_y double, fix_x double, fix_y double, available boolean, accuracy double, sats double, ai_x double, ai_y double"


def drives(seed):
    """Sessions of uneven length (one without a name) with outages, far fixes, rows without one, and rows without model."""
    rng, rows = random.Random(seed), []
    for session in [None, *range(30)]:
        lost, far = rng.randrange(60), rng.randrange(60)
        for seq in range(1, rng.choice((2, 40, 75))):
            away = 9000.0 if far < seq < far + 8 else 0.0
            fix = (None, None) if rng.random() < 0.1 else (away + rng.gauss(0, 3), rng.gauss(0, 3))
            model = (None, None) if rng.random() < 0.3 else (rng.gauss(0, 0.2), rng.gauss(0, 0.2))
            rows.append((session, seq, 0.1 * seq, rng.gauss(1, 1), rng.gauss(0, 1), *fix, rng.choice((True, True, True, None)) if not lost < seq < lost + 15 else False, rng.choice((None, 3.0, 8.0, 20.0, 60.0)), rng.choice((None, 4.0, 8.0)), *model))
    return rows


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_sessions_together_are_as_alone(spark, monkeypatch, batch):
    rows = drives(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r[0], r[1]): r[2:] for r in E.fold_together(spark.createDataFrame(rows, KINDS), E.FusionDriver, INPUTS, E.FusionDriver.OUTPUTS).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    alone, modes = {}, set()
    for session, seq, *row in rows:
        want = alone.setdefault(session, E.FusionDriver()).step(*row)
        got = found[session, seq]
        assert tuple(got[6:]) == want[6:]
        assert np.allclose(got[:6], want[:6], rtol=1e-9, atol=1e-9)
        modes.add(want[6])
    assert modes == {"GOOD", "DEGRADED", "LOST", "RECOVERING"}


def test_rows_of_one_place_take_one_step(spark, tmp_path):
    class Counting(E.FusionDriver):
        def steps(self, who, *columns):
            with open(f"{tmp_path}/steps", "a") as out:
                out.write(f"{len(who)}\n")
            return super().steps(who, *columns)

    rows = [(session, seq, 0.1 * seq, 1.0, 0.0, 0.1 * seq, 0.0, True, 3.0, 8.0, None, None) for session in range(200) for seq in range(1, 11)]
    found = E.fold_together(spark.createDataFrame(rows, KINDS), Counting, INPUTS, E.FusionDriver.OUTPUTS).collect()
    sizes = [int(x) for x in (tmp_path / "steps").read_text().split()]
    assert len(found) == sum(sizes) == 2000
    assert len(sizes) < 2000 / 4


def test_a_row_twice_takes_two_steps(spark):
    rows = [(1, 1, 0.1, 1.0, 0.0, 0.0, 0.0, True, 3.0, 8.0, None, None)] * 2
    assert len(E.fold_together(spark.createDataFrame(rows, KINDS), E.FusionDriver, INPUTS, E.FusionDriver.OUTPUTS).collect()) == 2
    none = spark.createDataFrame([], KINDS)
    assert E.fold_together(none, E.FusionDriver, INPUTS, E.FusionDriver.OUTPUTS).collect() == []
