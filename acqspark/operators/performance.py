"""Campaign performance fact, tiers, 30-day summary and revenue growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key, money_key, safe_ratio, month_start
from .daily import in_window
from .dims import as_of_date

PERF_METRICS = ["total_revenue", "total_users", "total_spend", "arpu", "roas", "conversion_rate",
                "forecasted_revenue", "high_roas_prob"]
IDS = ["campaign_id", "network_id", "platform_id"]

# Tier thresholds, labels and score weights of the models.
ROAS_TIERS = [(2.0, "Tier 1 - Excellent"), (1.0, "Tier 2 - Good"), (0.5, "Tier 3 - Average")]
ROAS_TIER_LOW = "Tier 4 - Poor"
REVENUE_TIERS = [(100000, "High Revenue"), (50000, "Medium Revenue"), (10000, "Low Revenue")]
REVENUE_TIER_LOW = "Very Low Revenue"
ACTION_SCALE = "Scale up - Increase budget"
ACTION_OPTIMIZE = "Optimize - Maintain budget, improve targeting"
ACTION_REVIEW = "Review - Reduce budget, analyze performance"
ACTION_PAUSE = "Pause - Poor performance, reallocate budget"
SUMMARY_WINDOW_DAYS = 30


def perf_named(metrics: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
               dim_platform: DataFrame, dim_date: DataFrame, as_of) -> DataFrame:
    """perf_fact plus the names (one join chain serves the fact and the
    enriched dashboard view)."""
    today = dim_date.select(F.col("date").alias("_as_of"), "date_id")
    j = (metrics
         .join(dim_campaign, "campaign_name")
         .join(dim_network, "network_name")
         .join(dim_platform, "platform")
         .withColumn("_as_of", as_of_date(as_of))
         .join(today, "_as_of"))
    key = surrogate_key("campaign_id", "network_id", "platform_id", money_key("total_revenue"), "total_users")
    return j.select(key.alias("campaign_performance_id"), *IDS, "date_id", *PERF_METRICS,
                    "platform", "campaign_name", "network_name")


def perf_by_name(metrics: DataFrame, as_of, calendar_start) -> DataFrame:
    """The same rows where every name of the metrics has its dimension row (the
    mart builds the dimensions from both inputs): the ids, of the day too, are
    functions of the names and the day. Empty where as_of lies before the calendar."""
    today = as_of_date(as_of)
    named = metrics.where("campaign_name IS NOT NULL AND network_name IS NOT NULL AND platform IS NOT NULL")
    j = named.where(today >= F.lit(calendar_start).cast("date")).withColumn("date_id", surrogate_key(today))
    j = j.withColumns({f"{d}_id": surrogate_key(name) for d, name in (("campaign", "campaign_name"), ("network", "network_name"), ("platform", "platform"))})
    key = surrogate_key("campaign_id", "network_id", "platform_id", money_key("total_revenue"), "total_users")
    return j.select(key.alias("campaign_performance_id"), *IDS, "date_id", *PERF_METRICS, "platform", "campaign_name", "network_name")


def perf_fact(metrics: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
              dim_platform: DataFrame, dim_date: DataFrame, as_of) -> DataFrame:
    """Campaign metrics with dimension ids and the date_id of ``as_of``. The
    model's cross join with a one-row "today" is an equi-join on the as_of
    date here: same result (empty when as_of is not in the calendar), and no
    cartesian product in the plan."""
    today = dim_date.select(F.col("date").alias("_as_of"), "date_id")
    j = (metrics
         .join(dim_campaign, "campaign_name")
         .join(dim_network, "network_name")
         .join(dim_platform, "platform")
         .withColumn("_as_of", as_of_date(as_of))
         .join(today, "_as_of"))
    key = surrogate_key("campaign_id", "network_id", "platform_id", money_key("total_revenue"), "total_users")
    return j.select(key.alias("campaign_performance_id"), *IDS, "date_id", *PERF_METRICS)


def perf_enriched(perf: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
                  dim_platform: DataFrame) -> DataFrame:
    """Performance metrics with names (dashboard / budget input)."""
    j = perf.join(dim_campaign, "campaign_id").join(dim_network, "network_id").join(dim_platform, "platform_id")
    return j.select(*IDS, *PERF_METRICS, "platform", "campaign_name", "network_name")


def _tier(col, tiers, low):
    c = F.col(col)
    out = F.when(c >= tiers[0][0], tiers[0][1])
    for thr, label in tiers[1:]:
        out = out.when(c >= thr, label)
    return out.otherwise(low)


def campaign_tiers(perf: DataFrame) -> DataFrame:
    """ROAS / revenue tiers, weighted score and action. The key carries network
    and platform ids too: campaign + tiers alone repeats across cells."""
    roas, rev = F.col("roas"), F.col("total_revenue")
    score = (roas * 0.4 + F.col("arpu") * 0.2 + F.col("high_roas_prob") * 0.2
             + F.when(F.col("conversion_rate") > 50, 0.2).otherwise(0.0))
    action = (F.when((roas >= 2.0) & (rev >= 100000), ACTION_SCALE)
              .when((roas >= 1.0) & (roas < 2.0), ACTION_OPTIMIZE)
              .when((roas >= 0.5) & (roas < 1.0), ACTION_REVIEW)
              .otherwise(ACTION_PAUSE))
    t = perf.select(*IDS, "roas", "arpu", "total_revenue", "total_users", "high_roas_prob", "conversion_rate",
                    _tier("roas", ROAS_TIERS, ROAS_TIER_LOW).alias("roas_tier"),
                    _tier("total_revenue", REVENUE_TIERS, REVENUE_TIER_LOW).alias("revenue_tier"),
                    score.alias("performance_score"), action.alias("recommended_action"))
    key = surrogate_key(*IDS, "roas_tier", "revenue_tier")
    return t.select(key.alias("performance_tier_id"), *t.columns)


def health_score(roas="roas", conversion_rate="conversion_rate", arpu="arpu", prob="high_roas_prob"):
    return (F.when(F.col(roas) > 1.0, 40).otherwise(0) + F.when(F.col(conversion_rate) > 50, 30).otherwise(0)
            + F.when(F.col(arpu) > 2.0, 20).otherwise(0) + F.when(F.col(prob) > 0.7, 10).otherwise(0))


def campaign_summary(perf: DataFrame, daily: DataFrame, dim_campaign: DataFrame | None,
                     dim_network: DataFrame | None, dim_platform: DataFrame | None, as_of,
                     previous: DataFrame | None = None,
                     window_days: int = SUMMARY_WINDOW_DAYS) -> DataFrame:
    """Totals plus last-30-day sums/averages per campaign cell.

    The model left-joins every daily row to the fact and then groups by 14
    columns; here the daily rows are filtered to the window and aggregated
    by the three ids first (the filter reaches the daily scan, the aggregate
    is partial), and the small result is joined. Sums of a cell with no daily
    rows are 0, averages stay NULL. Revenue growth compares with a previous
    snapshot of this table (``previous``); with none it is 0."""
    last = (daily.filter(in_window("date", as_of, window_days))
            .groupBy(*IDS)
            .agg(F.sum("daily_revenue").alias("last_30d_revenue"),
                 F.sum("daily_users").alias("last_30d_users"),
                 F.sum("daily_spend").alias("last_30d_spend"),
                 F.avg("daily_roas").alias("avg_30d_roas"),
                 F.avg("daily_arpu").alias("avg_30d_arpu")))
    j = perf.join(last, IDS, "left")
    if "campaign_name" not in perf.columns:  # a stored fact: fetch the names by id
        j = j.join(dim_campaign, "campaign_id").join(dim_network, "network_id").join(dim_platform, "platform_id")
    if previous is not None:
        prev = previous.select(*IDS, F.col("total_revenue").alias("_prev_revenue"))
        j = j.join(prev, IDS, "left")
        growth = F.when(F.col("_prev_revenue") > 0,
                        (F.col("total_revenue") - F.col("_prev_revenue")) / F.col("_prev_revenue")).otherwise(0.0)
    else:
        growth = F.lit(0.0)
    return j.select(
        surrogate_key(*IDS).alias("summary_id"), *IDS, "campaign_name", "network_name", "platform",
        *PERF_METRICS,
        F.coalesce("last_30d_revenue", F.lit(0.0)).alias("last_30d_revenue"),
        F.coalesce("last_30d_users", F.lit(0).cast("bigint")).alias("last_30d_users"),
        F.coalesce("last_30d_spend", F.lit(0.0)).alias("last_30d_spend"),
        "avg_30d_roas", "avg_30d_arpu",
        growth.alias("revenue_growth_rate"),
        safe_ratio("total_revenue", "total_spend").alias("overall_roas"),
        health_score().alias("campaign_health_score"),
    )


def revenue_growth(daily: DataFrame) -> DataFrame:
    """Month-over-month revenue growth per campaign cell from the daily fact
    (the snapshot history the model's lag() needs). The window runs over the
    monthly aggregate, a few rows per cell, never over raw rows."""
    m = (daily.groupBy(*IDS, month_start("date").alias("month_start"))
         .agg(F.sum("daily_revenue").alias("monthly_revenue")))
    w = Window.partitionBy(*IDS).orderBy("month_start")
    prev = F.lag("monthly_revenue").over(w)
    return (m.withColumn("prev_month_revenue", prev)
            .withColumn("revenue_growth_rate",
                        F.when(F.col("prev_month_revenue") > 0,
                               (F.col("monthly_revenue") - F.col("prev_month_revenue")) / F.col("prev_month_revenue"))
                        .otherwise(0.0)))
