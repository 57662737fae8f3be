"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query builds a ``Mart`` over the test tables of ``sf_dir`` (canonical
``user_data`` from ``events``, ``spend`` from ``orders``) and returns one of
its tables. Float columns are rounded (money to 4 places, ratios to 6) with
the same spec the SQL oracles use, because float sums depend on the order in
which an engine adds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_cols
from ..functions.metrics import as_date
from ..operators import attribution as attr
from ..operators import kpis, quality, reports, seasonality, staging, incremental, daily as daily_ops
from .mart import Mart

DAILY_M, DAILY_R = ["daily_revenue", "daily_spend"], ["daily_roas", "daily_arpu"]
PERF_M, PERF_R = ["total_revenue", "total_spend", "forecasted_revenue"], ["arpu", "roas"]

# query name -> (money columns, ratio columns)
ROUNDING: dict[str, tuple[list[str], list[str]]] = {
    "stg_campaign_metrics": (PERF_M, PERF_R),
    "perf_fact": (PERF_M, PERF_R),
    "perf_enriched": (PERF_M, PERF_R),
    "dash_platform_campaigns": (PERF_M, PERF_R),
    "campaign_summary": (PERF_M + ["last_30d_revenue", "last_30d_spend"],
                         PERF_R + ["avg_30d_roas", "avg_30d_arpu", "overall_roas", "revenue_growth_rate"]),
    "campaign_daily": (DAILY_M, DAILY_R),
    "daily_last7": (DAILY_M, DAILY_R),
    "merge_upsert_daily": (DAILY_M, DAILY_R),
    "spend_user_full_outer": (DAILY_M, DAILY_R),
    "daily_enriched": (DAILY_M, DAILY_R),
    "daily_spend": (["daily_spend"], []),
    "daily_users": (["daily_revenue"], []),
    "attribution_all": ([f"{m}_revenue" for m in ("first_touch", "last_touch", "linear", "time_decay", "position")],
                        [f"{m}_roas" for m in ("first_touch", "last_touch", "linear", "time_decay", "position")]),
    "attr_first_touch": (["first_touch_revenue"], []),
    "attr_last_touch": (["last_touch_revenue"], []),
    "attr_linear": (["linear_revenue"], []),
    "attr_linear_norm": (["linear_norm_revenue"], []),
    "attr_time_decay": (["time_decay_revenue"], []),
    "attr_time_decay_norm": (["time_decay_norm_revenue"], []),
    "attr_position": (["position_revenue"], []),
    "attr_position_norm": (["position_norm_revenue"], []),
    "campaign_tiers": (["total_revenue"], ["roas", "arpu", "performance_score"]),
    "budget_plan": (["total_spend", "recommended_spend", "spend_change", "projected_revenue", "projected_profit"],
                    ["efficiency_score", "roi_improvement_percent"]),
    "cohort_ltv": (["total_cohort_revenue"],
                   ["initial_arpu", "ltv_current", "ltv_3m_projected", "ltv_6m_projected", "ltv_12m_projected"]),
    "cohort_retention": (["cohort_revenue"], []),
    "touchpoints": (["device_revenue"], []),
    "kpi_campaign": (["total_revenue", "total_spend"], ["roas", "arpu"]),
    "kpi_forecast": (["total_revenue", "total_spend", "forecasted_revenue"], ["roas", "arpu"]),
    "dash_top_campaign": (["forecasted_revenue"], ["roas", "arpu"]),
    "spend_by_campaign": (["total_spend"], []),
    "daily_revenue_series": (["revenue_est"], []),
    "readme_daily_by_platform": (["revenue", "spend"], ["avg_roas"]),
    "revenue_growth": (["monthly_revenue", "prev_month_revenue"], ["revenue_growth_rate"]),
    "seasonal_patterns": (["seasonal_revenue", "seasonal_spend"], ["avg_seasonal_roas", "avg_seasonal_arpu"]),
    "dow_patterns": (["avg_daily_revenue"], ["avg_daily_roas", "avg_daily_arpu"]),
    "monthly_trends": (["monthly_revenue", "monthly_spend", "prev_month_revenue"],
                       ["avg_monthly_roas", "avg_monthly_arpu"]),
    "weekly_patterns": ([], ["avg_weekly_revenue", "avg_weekly_roas"]),
    "special_periods": ([], ["avg_daily_revenue", "avg_daily_roas"]),
    "seasonality_wide_stats": (["sum_seasonal_revenue", "sum_monthly_revenue"], []),
    "seasonality_long": (["seasonal_revenue", "seasonal_spend", "dow_avg_revenue", "monthly_revenue", "monthly_spend", "prev_month_revenue"],
                         ["avg_seasonal_roas", "avg_seasonal_arpu", "dow_avg_roas", "dow_avg_arpu", "avg_monthly_roas", "avg_monthly_arpu",
                          "avg_weekly_revenue", "avg_weekly_roas", "special_avg_revenue", "special_avg_roas"]),
    "high_roas_prob": (["total_revenue", "total_spend"], ["roas", "arpu", "high_roas_prob"]),
}

# The previous build of the incremental examples is the state this many days
# before as_of (staging) / the daily fact as of 3 days before as_of.
INCREMENTAL_CUT_DAYS = 30
STALE_DAILY_DAYS = 3


def _cv_buckets(m: Mart) -> DataFrame:
    """The bucket table with how often each bucket occurs among opt-out installs."""
    used = (m.stg_user_data.filter(F.col("cv_bucket").isNotNull())
            .groupBy("cv_bucket").agg(F.count("*").alias("installs")))
    return (m.buckets.join(used, "cv_bucket", "left")
            .select("cv_bucket", "rev_min", "rev_max",
                    F.coalesce("installs", F.lit(0).cast("bigint")).alias("installs")))


def _merge_upsert_daily(m: Mart) -> DataFrame:
    stale_as_of = F.date_sub(as_date(m.as_of), STALE_DAILY_DAYS)
    target = m.campaign_daily.filter(F.col("date") <= stale_as_of)
    return incremental.merge_daily(target, m.daily_last())


def _violations(m: Mart) -> DataFrame:
    v = quality.unique_violations(m.stg_user_data, "user_id")
    return quality.store_failures(v, ["user_id", "src_id"])


def _high_roas_prob(m: Mart) -> DataFrame:
    return kpis.campaign_metrics(m.kpi_forecast, m.classifier)


BUILDERS: dict[str, Callable[[Mart], DataFrame]] = {
    # sources and incremental
    "canon_spend": lambda m: m.spend,
    "canon_user_data": lambda m: m.user_data,
    "cv_buckets": _cv_buckets,
    "stg_spend_incremental": lambda m: staging.incremental_stg_spend(
        m.spend, F.date_sub(as_date(m.as_of), INCREMENTAL_CUT_DAYS)),
    "stg_user_incremental": lambda m: staging.incremental_stg_user_data(
        m.user_data, F.date_sub(as_date(m.as_of), INCREMENTAL_CUT_DAYS)),
    "merge_upsert_daily": _merge_upsert_daily,
    "daily_last7": lambda m: m.daily_last(),
    "dq_violations": _violations,
    # staging and dimensions
    "stg_spend": lambda m: m.stg_spend,
    "stg_user_data": lambda m: m.stg_user_data,
    "stg_campaign_metrics": lambda m: m.campaign_metrics,
    "dim_campaign": lambda m: m.dim_campaign,
    "dim_network": lambda m: m.dim_network,
    "dim_platform": lambda m: m.dim_platform,
    "dim_date": lambda m: m.dim_date,
    # daily
    "revenue_adjusted": lambda m: daily_ops.revenue_adjusted(m.stg_user_data),
    "daily_spend": lambda m: m.daily_spend,
    "daily_users": lambda m: m.daily_users,
    "spend_user_full_outer": lambda m: m.spend_user_full_outer,
    "campaign_daily": lambda m: m.campaign_daily,
    "daily_enriched": lambda m: m.daily_enriched,
    # notebook KPIs
    "revenue_midpoint": lambda m: m.revenue_midpoint,
    "kpi_campaign": lambda m: m.kpi_campaign,
    "spend_by_campaign": lambda m: m.spend_by_campaign,
    "daily_revenue_series": lambda m: kpis.daily_revenue_series(m.revenue_midpoint),
    "kpi_forecast": lambda m: m.kpi_forecast,
    "high_roas_prob": _high_roas_prob,
    # performance
    "perf_fact": lambda m: m.perf_fact,
    "perf_enriched": lambda m: m.perf_enriched,
    "campaign_tiers": lambda m: m.campaign_tiers,
    "campaign_summary": lambda m: m.campaign_summary,
    "revenue_growth": lambda m: m.revenue_growth,
    "budget_plan": lambda m: m.budget_plan,
    # attribution
    "touchpoints": lambda m: m.touchpoints,
    "attr_first_touch": lambda m: attr.first_touch(m.touchpoints),
    "attr_last_touch": lambda m: attr.last_touch(m.touchpoints),
    "attr_linear": lambda m: attr.linear(m.touchpoints),
    "attr_linear_norm": lambda m: attr.linear_norm(m.touchpoints),
    "attr_time_decay": lambda m: attr.time_decay(m.touchpoints),
    "attr_time_decay_norm": lambda m: attr.time_decay_norm(m.touchpoints),
    "attr_position": lambda m: attr.position(m.touchpoints),
    "attr_position_norm": lambda m: attr.position_norm(m.touchpoints),
    "attribution_all": lambda m: m.attribution_all,
    # cohorts
    "cohort_ltv": lambda m: m.cohort_ltv,
    "cohort_retention": lambda m: m.cohort_retention,
    # seasonality
    "seasonal_patterns": lambda m: m.seasonal["seasonal"],
    "dow_patterns": lambda m: m.seasonal["dow"],
    "monthly_trends": lambda m: m.seasonal["month"],
    "weekly_patterns": lambda m: m.seasonal["week"],
    "special_periods": lambda m: m.seasonal["special"],
    "seasonality_wide_stats": lambda m: seasonality.seasonality_wide_stats(m.season_measures),
    "seasonality_long": lambda m: m.seasonality_fact,
    # governance
    "dq_campaign": lambda m: m.checks["dq_campaign"],
    "dq_spend": lambda m: m.checks["dq_spend"],
    "dq_users": lambda m: m.checks["dq_users"],
    "dq_referential": lambda m: m.checks["dq_referential"],
    "dq_scores": lambda m: m.checks["dq_scores"],
    "dq_tiers": lambda m: m.checks["dq_tiers"],
    "dq_date_dim": lambda m: m.checks["dq_date_dim"],
    "dq_daily_partitions": lambda m: m.checks["dq_daily_partitions"],
    "dq_score_logic": lambda m: m.checks["dq_score_logic"],
    "test_unique_user_id": lambda m: quality.duplicate_keys(m.stg_user_data, "user_id"),
    "test_not_null": lambda m: quality.test_not_null(m.materialized().tested),
    "test_accepted_values": lambda m: quality.test_accepted_values(m.materialized().tested),
    "test_relationships": lambda m: quality.test_relationships(m.materialized().tested),
    "test_report": lambda m: m.test_report,
    "table_stats": lambda m: m.table_stats,
    "lineage": lambda m: m.lineage,
    # reports
    "readme_daily_by_platform": lambda m: reports.daily_by_platform(m.campaign_daily, m.dim_platform,
                                                                    m.dim_date, m.as_of),
    "readme_health": lambda m: reports.campaign_health(m.campaign_summary, m.campaign_tiers),
    "dash_platform_campaigns": lambda m: reports.platform_campaigns(m.perf_enriched),
    "dash_top_campaign": lambda m: reports.top_campaign(m.perf_enriched),
    "dash_platforms": lambda m: reports.platforms(m.perf_enriched),
}


def run(name: str, spark: SparkSession, sf_dir: str, **mart_kw) -> DataFrame:
    m = Mart.from_tables(spark, sf_dir, **mart_kw)
    df = BUILDERS[name](m)
    money, ratio = ROUNDING.get(name, ([], []))
    return round_cols(df, money, ratio)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in BUILDERS}
