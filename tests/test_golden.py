"""Golden values: the tier, health and budget rules applied to the five
published campaign rows (hand-computed expectations)."""

import pytest

from acqspark.operators import performance, budget

# The five published campaign rows (platform, campaign, network, revenue,
# users, spend, conversion rate, roas, arpu, forecast, high_roas, prob).
SEED = [
    ("android", "campaignA", "Network A", 148442.6294566759, 55923, 441736.5056, 100, 0.3360433823667118,
     2.654411055499095, 2755.591174468398, 1, 0.94),
    ("android", "campaignB", "Network A", 24995.289201244752, 4070, 52589.5928, 100, 0.4752896508688075,
     6.141348698094534, 980.0437144814059, 1, 0.74),
    ("android", "campaignC", "Network A", 55684.05245621435, 12015, 269001.7785, 100, 0.2070025438743125,
     4.634544524029492, 2377.5206062458456, 0, 0.3),
    ("ios", "campaignB", "Network A", 200689.28663363235, 166384, 313258.8126, 100, 0.6406500904729291,
     1.2061814034620657, 6002.83177588135, 1, 0.84),
    ("ios", "campaignC", "Network A", 54744.41132247912, 50529, 224959.8117, 100, 0.24335196099596987,
     1.0834255837732614, 2427.602281514555, 0, 0.28),
]
SCHEMA = ("platform string, campaign_name string, network_name string, total_revenue double, total_users bigint, "
          "total_spend double, conversion_rate int, roas double, arpu double, forecasted_revenue double, "
          "high_roas int, high_roas_prob double")

# (roas tier, revenue tier, score, action, health, efficiency, recommendation,
#  recommended spend, expected roas, projected revenue, projected profit, roi %)
GOLDEN = {
    ("android", "campaignA"): ("Tier 4 - Poor", "High Revenue", 1.053300, "Pause", 60, 71.641735, "Reduce",
                               220868.2528, 1.8, 397562.8550, 176694.6022, -10),
    ("android", "campaignB"): ("Tier 4 - Poor", "Low Revenue", 1.766386, "Pause", 60, 71.211586, "Reduce",
                               26294.7964, 1.8, 47330.6335, 21035.8371, -10),
    ("android", "campaignC"): ("Tier 4 - Poor", "Medium Revenue", 1.269710, "Pause", 50, 47.280102, "Reduce",
                               134500.8893, 1.2, 161401.0671, 26900.1779, -40),
    ("ios", "campaignB"): ("Tier 3 - Average", "High Revenue", 0.865496, "Review", 40, 70.826004, "Optimize",
                           250607.0501, 1.8, 451092.6901, 200485.6401, 44),
    ("ios", "campaignC"): ("Tier 4 - Poor", "Medium Revenue", 0.570026, "Pause", 30, 38.134078, "Reduce",
                           112479.9058, 0.8, 89983.9247, -22495.9812, -60),
}


@pytest.fixture(scope="module")
def seed(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(SEED, SCHEMA)
    # ids as the names themselves: the rules do not depend on them
    return df.withColumns({"campaign_id": F.col("campaign_name"), "network_id": F.col("network_name"),
                           "platform_id": F.col("platform")})


def test_tiers_and_actions(seed):
    rows = performance.campaign_tiers(seed).join(seed.select("campaign_id", "platform_id", "platform",
                                                             "campaign_name"), ["campaign_id", "platform_id"])
    for r in rows.collect():
        g = GOLDEN[(r["platform"], r["campaign_name"])]
        assert r["roas_tier"].startswith(g[0])
        assert r["revenue_tier"] == g[1]
        assert r["performance_score"] == pytest.approx(g[2], abs=1e-6)
        assert r["recommended_action"].startswith(g[3])


def test_health_score(seed):
    rows = seed.select("platform", "campaign_name", performance.health_score().alias("h")).collect()
    for r in rows:
        assert r["h"] == GOLDEN[(r["platform"], r["campaign_name"])][4]


def test_budget_plan(seed):
    for r in budget.budget_plan(seed).collect():
        g = GOLDEN[(r["platform"], r["campaign_name"])]
        assert r["efficiency_score"] == pytest.approx(g[5], abs=1e-6)
        assert r["budget_recommendation"] == g[6]
        assert r["recommended_spend"] == pytest.approx(g[7], abs=1e-4)
        assert r["expected_roas"] == g[8]
        assert r["projected_revenue"] == pytest.approx(g[9], abs=1e-4)
        assert r["projected_profit"] == pytest.approx(g[10], abs=1e-4)
        assert r["roi_improvement_percent"] == pytest.approx(g[11], abs=1e-9)
        # property: the spend change is the difference of the two spends
        assert r["recommended_spend"] - r["total_spend"] == pytest.approx(r["spend_change"], abs=1e-6)


def test_summary_growth_against_previous_snapshot(seed, spark):
    from pyspark.sql import functions as F
    daily = spark.createDataFrame([], "campaign_id string, network_id string, platform_id string, date date, "
                                      "daily_revenue double, daily_users bigint, daily_spend double, "
                                      "daily_roas double, daily_arpu double")
    first = performance.campaign_summary(seed, daily, None, None, None, "2024-04-30")
    assert {r["revenue_growth_rate"] for r in first.collect()} == {0.0}
    prev = seed.withColumn("total_revenue", F.col("total_revenue") / 2)
    grown = performance.campaign_summary(seed, daily, None, None, None, "2024-04-30", previous=prev)
    for r in grown.collect():
        assert r["revenue_growth_rate"] == pytest.approx(1.0)
        assert r["last_30d_users"] == 0 and r["avg_30d_roas"] is None
