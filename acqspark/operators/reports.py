"""Reporting queries: README examples and the dashboard data feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .daily import in_window

DASH_COLS = ["total_revenue", "total_users", "total_spend", "arpu", "roas", "conversion_rate",
             "forecasted_revenue", "high_roas_prob", "platform", "campaign_name", "network_name"]
DEFAULT_PLATFORM = "android"


def daily_by_platform(daily: DataFrame, dim_platform: DataFrame, dim_date: DataFrame, as_of,
                      days: int = 30) -> DataFrame:
    """Revenue, spend and average ROAS per platform and day, last 30 days."""
    j = (daily.join(dim_platform, "platform_id")
         .join(dim_date.select("date_id", F.col("date").alias("d_date")), "date_id")
         .filter(in_window("d_date", as_of, days)))
    return (j.groupBy("platform", F.col("d_date").alias("date"))
            .agg(F.sum("daily_revenue").alias("revenue"), F.sum("daily_spend").alias("spend"),
                 F.avg("daily_roas").alias("avg_roas"))
            .orderBy(F.col("date").desc(), "platform"))


def campaign_health(summary: DataFrame, tiers: DataFrame) -> DataFrame:
    """Health score with the tier's recommended action. The summary has no
    action column, so it is joined from the tier table on the cell ids."""
    t = tiers.select("campaign_id", "network_id", "platform_id", "recommended_action")
    j = summary.join(t, ["campaign_id", "network_id", "platform_id"], "left")
    return (j.select("campaign_name", "network_name", "platform", "campaign_health_score", "recommended_action")
            .orderBy(F.col("campaign_health_score").desc(), "campaign_name", "network_name", "platform"))


def platform_campaigns(enriched: DataFrame, platform: str = DEFAULT_PLATFORM) -> DataFrame:
    return enriched.filter(F.col("platform") == platform).select(*DASH_COLS)


def platforms(enriched: DataFrame) -> DataFrame:
    return enriched.select("platform").distinct()


def top_campaign(enriched: DataFrame) -> DataFrame:
    """Highest-ROAS campaign per platform (first by name on ties), as one
    aggregate: min_by over (-roas, names) is partial and skew-safe, where a
    window per platform would put each platform in one task."""
    e = enriched.filter(F.col("roas").isNotNull())
    best = F.min_by(F.struct("campaign_name", "network_name", "roas", "arpu", "forecasted_revenue"),
                    F.struct(-F.col("roas"), F.col("campaign_name"), F.col("network_name")))
    g = e.groupBy("platform").agg(best.alias("t")).select("platform", "t.*")
    text = F.concat(F.lit("Top Campaign: "), F.col("campaign_name"),
                    F.lit(" | ROAS: "), F.format_string("%.2f", "roas"),
                    F.lit(" | ARPU: "), F.format_string("%.2f", "arpu"),
                    F.lit(" | Forecasted Revenue: $"), F.format_number("forecasted_revenue", 2))
    return g.withColumn("summary_text", text)
