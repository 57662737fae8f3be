"""Physical-plan properties the design relies on."""

import pytest

from acqspark.plans.mart import Mart
from acqspark.plans.registry import run

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def mart(spark):
    return Mart.from_tables(spark, SF_SMALL)


def test_scans_are_pruned(mart):
    plan = _plan(mart.campaign_daily)
    assert "props" not in plan  # events.props is never read
    assert "o_orderdate" not in plan


def test_perf_fact_has_no_cartesian_product(mart):
    plan = _plan(mart.perf_fact)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bucket_table_is_broadcast(mart):
    assert "BroadcastHashJoin" in _plan(mart.revenue_midpoint)


def test_attribution_is_one_window_and_one_aggregate(mart):
    plan = _plan(mart.attribution_all)
    assert plan.count("Window [") <= 2  # row_number and count share one partitioning
    assert "CartesianProduct" not in plan


def test_top_campaign_uses_aggregate_not_window(mart, spark):
    plan = _plan(run("dash_top_campaign", spark, SF_SMALL))
    assert "min_by" in plan.lower() or "ObjectHashAggregate" in plan or "SortAggregate" in plan
