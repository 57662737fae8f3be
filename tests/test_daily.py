import datetime as dt

import pytest
from pyspark.sql import functions as F

from acqspark.operators import daily, dims, staging

D = dt.date


@pytest.fixture(scope="module")
def inputs(spark):
    spend = spark.createDataFrame([
        (1, D(2024, 1, 1), "ios", "n1", "c1", 10.0),
        (2, D(2024, 1, 1), "ios", "n1", "c1", 5.0),
        (3, D(2024, 1, 2), "ios", "n1", "c1", 0.0),     # zero spend, no users
        (4, D(2024, 1, 3), "ios", "nX", "c1", 1.0),     # network unknown to the dims
    ], "src_id bigint, date date, platform string, network_name string, campaign_name string, spend double")
    users = spark.createDataFrame([
        (1, "u1", "ios", D(2024, 1, 1), "c1", "n1", 3.0, None, "Opt in"),
        (2, "u1", "ios", D(2024, 1, 1), "c1", "n1", 1.0, None, "Opt in"),   # same device twice
        (3, "u2", "ios", D(2024, 1, 4), "c1", "n1", None, 10, "Opt out"),   # users only
    ], "src_id bigint, adid string, platform string, install_date date, campaign_name string, network_name string, "
       "revenue_usd double, cv_bucket int, tracking_status string")
    return staging.stg_spend(spend), staging.stg_user_data(users)


def test_full_outer_zero_fills_and_guards(inputs):
    s, u = inputs
    fo = daily.spend_user_full_outer(daily.daily_spend(s), daily.daily_users(u))
    rows = {(r["date"], r["network_name"]): r for r in fo.collect()}
    assert len(rows) == 4
    r = rows[(D(2024, 1, 1), "n1")]
    assert (r["daily_users"], r["daily_revenue"], r["daily_spend"]) == (1, 4.0, 15.0)
    assert r["daily_roas"] == pytest.approx(4 / 15) and r["daily_arpu"] == 4.0
    z = rows[(D(2024, 1, 2), "n1")]
    assert (z["daily_users"], z["daily_roas"], z["daily_arpu"]) == (0, 0.0, 0.0)
    only_users = rows[(D(2024, 1, 4), "n1")]
    assert only_users["daily_spend"] == 0.0 and only_users["daily_revenue"] == pytest.approx(0.5)


def test_campaign_daily_inner_joins_dims(inputs, spark):
    s, u = inputs
    names = spark.createDataFrame([("c1", "n1", "ios")], "campaign_name string, network_name string, platform string")
    fo = daily.spend_user_full_outer(daily.daily_spend(s), daily.daily_users(u))
    cd = daily.campaign_daily(fo, dims.dim_campaign(names), dims.dim_network(names), dims.dim_platform(names),
                              dims.dim_date(spark, D(2024, 1, 10)))
    assert cd.count() == 3  # the nX row is dropped by the inner join, as in the model
    assert cd.select("campaign_daily_id").distinct().count() == 3


def test_window_filter_reaches_below_aggregate(inputs):
    s, _ = inputs
    plan = daily.daily_spend(s, D(2024, 1, 3), 1)._jdf.queryExecution().optimizedPlan().toString()
    # the date filter is applied before the Aggregate
    assert plan.index("Aggregate") < plan.index("Filter")


def test_dim_date_calendar(spark):
    dd = dims.dim_date(spark, D(2024, 7, 28))
    assert dd.count() == (D(2026, 7, 28) - D(2024, 1, 1)).days
    r = dd.filter(F.col("date") == D(2024, 3, 2)).first()
    assert (r["day_of_week"], r["day_type"], r["season"], r["quarter"], r["week_of_year"]) == \
        ("Saturday", "Weekend", "Spring", 1, 9)


def test_approximate_distinct_users_option(inputs):
    _, u = inputs
    exact = {r["date"]: r["daily_users"] for r in daily.daily_users(u).collect()}
    approx = {r["date"]: r["daily_users"] for r in daily.daily_users(u, approx_rsd=0.01).collect()}
    assert approx == exact  # tiny groups are exact under HLL++
