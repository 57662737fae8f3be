import pytest
from pyspark.sql import functions as F

from acqspark.operators import seasonality
from acqspark.plans.mart import Mart

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def dp(spark):
    return Mart.from_tables(spark, SF_SMALL).daily_enriched


def test_wide_stats_equal_brute_force_wide_table(dp):
    m = seasonality.measures(dp)
    stats = {r["platform"]: r for r in seasonality.seasonality_wide_stats(m).collect()}
    wide = None  # the product of the five tables, on a small input only
    for t in seasonality.seasonality_tables(m).values():
        t = t.withColumnRenamed("total_users", f"users_of_{len(t.columns)}")
        t = t.select("platform", *[c for c in t.columns if wide is None or c not in wide.columns])
        wide = t if wide is None else wide.join(t, "platform")
    brute = wide.groupBy("platform").agg(
        F.count("*").alias("rows"), F.sum("seasonal_users").alias("su"), F.sum("users_of_9").alias("du"),
        F.sum("weeks_tracked").alias("wt"), F.sum("seasonal_revenue").alias("sr"),
        F.sum("monthly_revenue").alias("mr"))
    for r in brute.collect():
        s = stats[r["platform"]]
        assert s["wide_rows"] == r["rows"]
        assert s["sum_seasonal_users"] == r["su"] and s["sum_dow_total_users"] == r["du"]
        assert s["sum_weeks_tracked"] == r["wt"]
        assert s["sum_seasonal_revenue"] == pytest.approx(r["sr"])
        assert s["sum_monthly_revenue"] == pytest.approx(r["mr"])


def test_index_is_100_for_nonpositive_average(spark):
    dp = spark.createDataFrame([("ios", "n", "c", "Winter", 1, "Monday", 1, 0.0, 1.0, 0.0, 0.0, 1)],
                               "platform string, network_name string, campaign_name string, season string, "
                               "date int, day_of_week string, month int, daily_revenue double, daily_spend double, "
                               "daily_roas double, daily_arpu double, daily_users bigint")
    r = seasonality.seasonal_patterns(seasonality.measures(dp)).first()
    assert r["seasonal_performance_index"] == 100.0 and r["season_classification"] == "Good Season"


def test_one_reading_of_the_daily_fact(spark):
    m = Mart.from_tables(spark, SF_SMALL)
    plan = m.seasonal["seasonal"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1 and plan.count("orders.parquet") == 1


def test_every_long_row_has_an_id(dp):
    t = seasonality.seasonality_tables(seasonality.measures(dp))
    long = seasonality.seasonality_long(t)
    assert long.count() == sum(x.count() for x in t.values())
    assert long.select("seasonality_id").distinct().count() == long.count()
    for grain, keys in seasonality.GRAINS.items():
        assert long.where((F.col("grain") == grain) & F.col(keys[0]).isNull()).isEmpty()
