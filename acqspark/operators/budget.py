"""Budget recommendation and spend simulation per campaign cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import surrogate_key, safe_ratio

# Recommendation labels, spend multipliers and expected-ROAS steps.
SCALE_UP, MAINTAIN, OPTIMIZE, REDUCE = "Scale Up", "Maintain", "Optimize", "Reduce"
SPEND_MULTIPLIER = {SCALE_UP: 1.5, MAINTAIN: 1.0, OPTIMIZE: 0.8, REDUCE: 0.5}
SPEND_CHANGE = {SCALE_UP: 0.5, MAINTAIN: 0.0, OPTIMIZE: -0.2, REDUCE: -0.5}
EXPECTED_ROAS_STEPS = [(80, 2.5), (60, 1.8), (40, 1.2)]
EXPECTED_ROAS_LOW = 0.8


def efficiency_score():
    return (F.col("roas") * 40 + F.col("high_roas_prob") * 30 + F.col("conversion_rate") / 100 * 20
            + F.when(F.col("arpu") > 2.0, 10).otherwise(0))


def budget_recommendation():
    roas, prob = F.col("roas"), F.col("high_roas_prob")
    return (F.when((roas > 2.0) & (prob > 0.8), SCALE_UP)
            .when((roas > 1.0) & (roas <= 2.0), MAINTAIN)
            .when((roas > 0.5) & (roas <= 1.0), OPTIMIZE)
            .otherwise(REDUCE))


def _by_label(label_col, table):
    c = F.col(label_col)
    out = None
    for label in (SCALE_UP, MAINTAIN, OPTIMIZE):
        out = F.when(c == label, table[label]) if out is None else out.when(c == label, table[label])
    return out.otherwise(table[REDUCE])


def budget_plan(enriched: DataFrame) -> DataFrame:
    """Efficiency score, recommendation, simulated spend and projected outcome.
    Row-local arithmetic only: no shuffle beyond the input's."""
    b = enriched.select("campaign_name", "network_name", "platform", "total_spend", "roas", "arpu",
                        "high_roas_prob", "conversion_rate",
                        efficiency_score().alias("efficiency_score"),
                        budget_recommendation().alias("budget_recommendation"))
    spend, eff = F.col("total_spend"), F.col("efficiency_score")
    expected = F.when(eff >= EXPECTED_ROAS_STEPS[0][0], EXPECTED_ROAS_STEPS[0][1])
    for thr, val in EXPECTED_ROAS_STEPS[1:]:
        expected = expected.when(eff >= thr, val)
    expected = expected.otherwise(EXPECTED_ROAS_LOW)
    b = b.select("*",
                 (spend * _by_label("budget_recommendation", SPEND_MULTIPLIER)).alias("recommended_spend"),
                 (spend * _by_label("budget_recommendation", SPEND_CHANGE)).alias("spend_change"),
                 expected.alias("expected_roas"))
    rec, exp = F.col("recommended_spend"), F.col("expected_roas")
    rec_label = F.col("budget_recommendation")
    priority = (F.when((eff >= 80) & (rec_label == SCALE_UP), "High Priority")
                .when((eff >= 60) & (rec_label == MAINTAIN), "Medium Priority")
                .when((eff >= 40) & (rec_label == OPTIMIZE), "Low Priority")
                .otherwise("Review Required"))
    risk = F.when(eff >= 80, "Low Risk").when(eff >= 60, "Medium Risk").otherwise("High Risk")
    return b.select(
        surrogate_key("campaign_name", "network_name", "platform").alias("optimization_id"),
        "campaign_name", "network_name", "platform", "total_spend", "efficiency_score",
        "budget_recommendation", "recommended_spend", "spend_change", "expected_roas",
        (rec * exp).alias("projected_revenue"),
        (rec * exp - rec).alias("projected_profit"),
        safe_ratio(rec * exp - spend, spend).alias("_roi_ratio"),
        priority.alias("allocation_priority"), risk.alias("risk_level"),
    ).withColumn("roi_improvement_percent", F.col("_roi_ratio") * 100).select(
        "optimization_id", "campaign_name", "network_name", "platform", "total_spend", "efficiency_score",
        "budget_recommendation", "recommended_spend", "spend_change", "expected_roas", "projected_revenue",
        "projected_profit", "roi_improvement_percent", "allocation_priority", "risk_level")
