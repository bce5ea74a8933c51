"""Every core query against its SQL on the smallest tables, and the plans that matter."""

import pytest

from tests.oracle import SF, connect, of_frame, of_sql
from waymark.plans.adapter import telemetry
from waymark.plans.catalog import ORACLES, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert of_frame(QUERIES[name](spark, SF)) == of_sql(connect(), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_on_every_row(spark, name):
    n = telemetry(spark, SF).count()
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == (telemetry(spark, SF).select("session_id").distinct().count() if name == "session_split" else n)


def test_entry_has_rows(spark):
    assert flagship(spark, SF).count() > 0


def test_one_exchange_serves_windows_and_metrics(spark):
    plan = QUERIES["trip_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
