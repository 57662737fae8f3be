"""Governance: data-quality checks and scores, column tests, test report,
stored failures. Each check is one aggregate pass over its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key
from ..functions.metrics import as_date
from .daily import in_window

# Accepted-value domains used by checks and tests.
PLATFORMS = ("android", "ios")
TRACKING = ("Opt in", "Opt out")
ROAS_TIER_VALUES = ("Tier 1 - Excellent", "Tier 2 - Good", "Tier 3 - Average", "Tier 4 - Poor")
REVENUE_TIER_VALUES = ("High Revenue", "Medium Revenue", "Low Revenue", "Very Low Revenue")
ACTION_VALUES = ("Scale up - Increase budget", "Optimize - Maintain budget, improve targeting",
                 "Review - Reduce budget, analyze performance", "Pause - Poor performance, reallocate budget")
ATTRIBUTION_LABELS = ("Position-based (assisted conversions important)", "Linear (multi-touch journey common)",
                      "Time-decay (recent interactions matter)", "Last-touch (direct response dominant)")
BUDGET_VALUES = ("Scale Up", "Maintain", "Optimize", "Reduce")
PRIORITY_VALUES = ("High Priority", "Medium Priority", "Low Priority", "Review Required")
RISK_VALUES = ("Low Risk", "Medium Risk", "High Risk")
STATUS_VALUES = ("Excellent", "Good", "Fair", "Poor")

SCORE_COLUMNS = ["total_records", "null_campaign_ids", "null_network_ids", "null_platform_ids", "null_spend_ids",
                 "null_dates", "null_user_ids", "null_adids", "null_install_dates", "negative_revenue",
                 "negative_spend", "negative_roas", "invalid_platforms", "invalid_tracking_status",
                 "orphaned_campaigns", "orphaned_networks", "orphaned_platforms"]
# bad-row counters per check, in the order the score adds them
CHECK_BAD = {
    "campaign_data_completeness": ["null_campaign_ids", "null_network_ids", "null_platform_ids",
                                   "negative_revenue", "negative_spend", "negative_roas"],
    "spend_data_consistency": ["null_spend_ids", "null_dates", "negative_spend", "invalid_platforms"],
    "user_data_quality": ["null_user_ids", "null_adids", "null_install_dates", "invalid_platforms",
                          "invalid_tracking_status"],
    "referential_integrity": ["orphaned_campaigns", "orphaned_networks", "orphaned_platforms"],
}


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name of many frames, paired as a balanced tree: PySpark
    analyzes every union call eagerly, so a left-deep chain re-analyzes the
    growing plan once per part (quadratic); pairing makes it n log n."""
    parts = list(parts)
    while len(parts) > 1:
        nxt = [a.unionByName(b) for a, b in zip(parts[0::2], parts[1::2])]
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0]


def _isnull(c):
    return F.count_if(F.col(c).isNull())


def _neg(c):
    return F.count_if(F.col(c) < 0)


def _not_in(c, values):
    return F.count_if(~F.col(c).isin(*values))


def _labelled(df: DataFrame, check_type: str, table_name: str) -> DataFrame:
    return df.select(F.lit(check_type).alias("check_type"), F.lit(table_name).alias("table_name"), "*")


def dq_campaign(perf: DataFrame) -> DataFrame:
    g = perf.agg(F.count("*").alias("total_records"), _isnull("campaign_id").alias("null_campaign_ids"),
                 _isnull("network_id").alias("null_network_ids"), _isnull("platform_id").alias("null_platform_ids"),
                 _neg("total_revenue").alias("negative_revenue"), _neg("total_spend").alias("negative_spend"),
                 _neg("roas").alias("negative_roas"))
    return _labelled(g, "campaign_data_completeness", "fact_campaign_performance")


def dq_spend(stg_spend: DataFrame) -> DataFrame:
    g = stg_spend.agg(F.count("*").alias("total_records"), _isnull("spend_id").alias("null_spend_ids"),
                      _isnull("date").alias("null_dates"), _neg("spend").alias("negative_spend"),
                      _not_in("platform", PLATFORMS).alias("invalid_platforms"))
    return _labelled(g, "spend_data_consistency", "stg_spend")


def dq_users(stg_users: DataFrame) -> DataFrame:
    g = stg_users.agg(F.count("*").alias("total_records"), _isnull("user_id").alias("null_user_ids"),
                      _isnull("adid").alias("null_adids"), _isnull("install_date").alias("null_install_dates"),
                      _not_in("platform", PLATFORMS).alias("invalid_platforms"),
                      _not_in("tracking_status", TRACKING).alias("invalid_tracking_status"))
    return _labelled(g, "user_data_quality", "stg_user_data")


def dq_referential(perf: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
                   dim_platform: DataFrame) -> DataFrame:
    f = perf.select("campaign_id", "network_id", "platform_id")
    for dim, col in ((dim_campaign, "campaign_id"), (dim_network, "network_id"), (dim_platform, "platform_id")):
        d = dim.select(F.col(col).alias(f"_{col}"), F.lit(True).alias(f"_has_{col}"))
        f = f.join(d, f[col] == d[f"_{col}"], "left").drop(f"_{col}")
    g = f.agg(F.count("*").alias("total_records"),
              F.count_if(F.col("_has_campaign_id").isNull()).alias("orphaned_campaigns"),
              F.count_if(F.col("_has_network_id").isNull()).alias("orphaned_networks"),
              F.count_if(F.col("_has_platform_id").isNull()).alias("orphaned_platforms"))
    return _labelled(g, "referential_integrity", "foreign_key_constraints")


def dq_scores(*checks: DataFrame) -> DataFrame:
    """Union the checks by column name (a check's missing counters are NULL:
    not applicable) and score each with its own counters:
    round((1 - bad / nullif(total, 0)) * 100, 2); an empty table scores NULL."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checks)
    for c in SCORE_COLUMNS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("bigint"))
    total = F.nullif(F.col("total_records"), F.lit(0))
    score = None
    for check, bad in CHECK_BAD.items():
        s = F.round((F.lit(1.0) - reduce(lambda a, b: a + b, [F.col(c) for c in bad]) / total) * 100, 2)
        score = (F.when(F.col("check_type") == check, s) if score is None
                 else score.when(F.col("check_type") == check, s))
    score = score.otherwise(F.lit(0.0))
    u = u.withColumn("data_quality_score", score)
    q = F.col("data_quality_score")
    status = F.when(q >= 95, "Excellent").when(q >= 85, "Good").when(q >= 70, "Fair").otherwise("Poor")
    return u.select(surrogate_key("check_type", "table_name").alias("quality_check_id"), "check_type",
                    "table_name", *SCORE_COLUMNS, "data_quality_score", status.alias("data_quality_status"))


def dq_tiers(tiers: DataFrame) -> DataFrame:
    return tiers.agg(F.count("*").alias("total_campaigns"),
                     _not_in("roas_tier", ROAS_TIER_VALUES).alias("invalid_roas_tiers"),
                     _not_in("revenue_tier", REVENUE_TIER_VALUES).alias("invalid_revenue_tiers"),
                     _not_in("recommended_action", ACTION_VALUES).alias("invalid_actions"))


def dq_date_dim(dim_date: DataFrame, as_of) -> DataFrame:
    d = dim_date.filter(F.col("date") >= F.add_months(as_date(as_of), -12))
    return d.agg(F.count("*").alias("total_dates"), F.min("date").alias("min_date"),
                 F.max("date").alias("max_date"),
                 _isnull("day_of_week").alias("null_day_of_week"), _isnull("season").alias("null_seasons"))


def dq_daily_partitions(daily: DataFrame, as_of, days: int = 30) -> DataFrame:
    d = daily.filter(in_window("date", as_of, days))
    return d.agg(F.count_distinct("date").alias("distinct_dates"), F.min("date").alias("min_date"),
                 F.max("date").alias("max_date"), F.count("*").alias("total_records"))


def dq_score_logic(scores: DataFrame) -> DataFrame:
    s = F.col("data_quality_score")
    return scores.agg(F.count("*").alias("total_checks"),
                      F.count_if((s < 0) | (s > 100)).alias("invalid_scores"),
                      _not_in("data_quality_status", STATUS_VALUES).alias("invalid_statuses"))


# ---------------------------------------------------------------- column tests
# The column tests declared for each model.
NOT_NULL = {
    "dim_campaign": ["campaign_id", "campaign_name"],
    "dim_network": ["network_id", "network_name"],
    "dim_platform": ["platform_id", "platform"],
    "dim_date": ["date_id", "date"],
    "dim_campaign_performance_tier": ["performance_tier_id", "campaign_id", "roas", "arpu", "total_revenue",
                                      "roas_tier", "revenue_tier", "performance_score", "recommended_action"],
    "fact_campaign_performance": ["campaign_performance_id", "campaign_id", "network_id", "platform_id", "date_id",
                                  "total_revenue", "total_users", "total_spend", "arpu", "roas", "conversion_rate",
                                  "forecasted_revenue", "high_roas_prob"],
    "fact_campaign_daily": ["campaign_daily_id", "campaign_id", "network_id", "platform_id", "date_id", "date",
                            "daily_users", "daily_revenue", "daily_spend", "daily_roas", "daily_arpu"],
    "fact_campaign_summary": ["summary_id", "campaign_id", "network_id", "platform_id", "campaign_name",
                              "network_name", "platform", "total_revenue", "total_users", "total_spend",
                              "last_30d_revenue", "last_30d_users", "last_30d_spend", "avg_30d_roas",
                              "revenue_growth_rate", "campaign_health_score"],
    "fact_user_cohort_analysis": ["cohort_analysis_id", "cohort_month", "platform", "cohort_size",
                                  "total_cohort_revenue", "initial_arpu", "ltv_current", "ltv_3m_projected",
                                  "ltv_6m_projected", "ltv_12m_projected", "retention_rate",
                                  "cohort_quality_score"],
    "fact_multi_touch_attribution": ["attribution_id", "platform", "campaign_name", "network_name",
                                     "first_touch_users", "first_touch_revenue", "first_touch_roas",
                                     "last_touch_users", "last_touch_revenue", "last_touch_roas", "linear_users",
                                     "linear_revenue", "linear_roas", "time_decay_users", "time_decay_revenue",
                                     "time_decay_roas", "position_users", "position_revenue", "position_roas",
                                     "recommended_model"],
    "fact_budget_optimization": ["optimization_id", "campaign_name", "network_name", "platform", "total_spend",
                                 "efficiency_score", "budget_recommendation", "recommended_spend", "spend_change",
                                 "expected_roas", "projected_revenue", "projected_profit",
                                 "roi_improvement_percent", "allocation_priority", "risk_level"],
    "fact_seasonality_analysis": ["seasonality_id", "platform", "network_name", "campaign_name", "season",
                                  "days_in_season", "seasonal_revenue", "seasonal_spend", "avg_seasonal_roas",
                                  "seasonal_performance_index", "season_classification", "day_of_week",
                                  "dow_avg_revenue", "dow_avg_roas", "day_classification", "month",
                                  "monthly_revenue", "mom_growth_percent", "week_of_year",
                                  "week_performance_tier", "special_period"],
    "stg_spend": ["spend_id", "date", "platform", "network_name", "campaign_name", "spend"],
    "stg_user_data": ["user_id", "adid", "platform", "install_date", "campaign_name", "network_name"],
}
UNIQUE = {
    "dim_campaign": "campaign_id", "dim_network": "network_id", "dim_platform": "platform_id",
    "dim_date": "date_id", "dim_campaign_performance_tier": "performance_tier_id",
    "fact_campaign_performance": "campaign_performance_id", "fact_campaign_daily": "campaign_daily_id",
    "fact_campaign_summary": "summary_id", "fact_user_cohort_analysis": "cohort_analysis_id",
    "fact_multi_touch_attribution": "attribution_id", "fact_budget_optimization": "optimization_id",
    "fact_seasonality_analysis": "seasonality_id", "stg_spend": "spend_id", "stg_user_data": "user_id",
}
ACCEPTED = [
    ("dim_platform", "platform", PLATFORMS),
    ("dim_campaign_performance_tier", "roas_tier", ROAS_TIER_VALUES),
    ("dim_campaign_performance_tier", "revenue_tier", REVENUE_TIER_VALUES),
    ("dim_campaign_performance_tier", "recommended_action", ACTION_VALUES),
    ("fact_campaign_summary", "platform", PLATFORMS),
    ("fact_user_cohort_analysis", "platform", PLATFORMS),
    ("fact_multi_touch_attribution", "platform", PLATFORMS),
    ("fact_multi_touch_attribution", "recommended_model", ATTRIBUTION_LABELS),
    ("fact_budget_optimization", "platform", PLATFORMS),
    ("fact_budget_optimization", "budget_recommendation", BUDGET_VALUES),
    ("fact_budget_optimization", "allocation_priority", PRIORITY_VALUES),
    ("fact_budget_optimization", "risk_level", RISK_VALUES),
    ("fact_seasonality_analysis", "platform", PLATFORMS),
    ("fact_seasonality_analysis", "season", ("Winter", "Spring", "Summer", "Fall")),
    ("fact_seasonality_analysis", "season_classification", ("Peak Season", "Good Season", "Average Season", "Low Season")),
    ("fact_seasonality_analysis", "day_of_week", ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")),
    ("fact_seasonality_analysis", "day_classification", ("Best Day", "Good Day", "Average Day", "Poor Day")),
    ("fact_seasonality_analysis", "week_performance_tier", ("High Performance Week", "Low Performance Week", "Average Week")),
    ("fact_seasonality_analysis", "special_period", ("Holiday Season Weekend", "Holiday Season", "Black Friday Period",
                                                     "New Year Weekend", "Summer Weekend", "Regular Period")),
    ("stg_spend", "platform", PLATFORMS),
    ("stg_user_data", "platform", PLATFORMS),
    ("stg_user_data", "tracking_status", TRACKING),
]
RELATIONSHIPS = [
    ("dim_campaign_performance_tier", "campaign_id", "dim_campaign", "campaign_id"),
    ("fact_campaign_performance", "campaign_id", "dim_campaign", "campaign_id"),
    ("fact_campaign_performance", "network_id", "dim_network", "network_id"),
    ("fact_campaign_performance", "platform_id", "dim_platform", "platform_id"),
    ("fact_campaign_performance", "date_id", "dim_date", "date_id"),
    ("fact_campaign_performance", "total_revenue", "stg_campaign_metrics", "total_revenue"),
    ("fact_campaign_performance", "total_users", "stg_campaign_metrics", "total_users"),
    ("fact_campaign_performance", "total_spend", "stg_campaign_metrics", "total_spend"),
    ("fact_campaign_performance", "arpu", "stg_campaign_metrics", "arpu"),
    ("fact_campaign_performance", "roas", "stg_campaign_metrics", "roas"),
    ("fact_campaign_performance", "conversion_rate", "stg_campaign_metrics", "conversion_rate"),
    ("fact_campaign_performance", "forecasted_revenue", "stg_campaign_metrics", "forecasted_revenue"),
    ("fact_campaign_performance", "high_roas_prob", "stg_campaign_metrics", "high_roas_prob"),
    ("fact_campaign_daily", "campaign_id", "dim_campaign", "campaign_id"),
    ("fact_campaign_daily", "network_id", "dim_network", "network_id"),
    ("fact_campaign_daily", "platform_id", "dim_platform", "platform_id"),
    ("fact_campaign_daily", "date_id", "dim_date", "date_id"),
    ("fact_campaign_summary", "campaign_id", "dim_campaign", "campaign_id"),
    ("fact_campaign_summary", "network_id", "dim_network", "network_id"),
    ("fact_campaign_summary", "platform_id", "dim_platform", "platform_id"),
    ("stg_spend", "spend", "spend", "spend"),
    ("stg_user_data", "revenue_usd", "user_data", "revenue_usd"),
    ("stg_user_data", "cv_bucket", "dim_cv_bucket", "cv_bucket"),
]
# The seasonality fact holds the rows of five grains; a column is tested on its own.
GRAIN_OF = {c: grain for grain, columns in {
    "season": ("network_name", "campaign_name", "season", "days_in_season", "seasonal_revenue", "seasonal_spend",
               "avg_seasonal_roas", "seasonal_performance_index", "season_classification"),
    "day_of_week": ("day_of_week", "dow_avg_revenue", "dow_avg_roas", "day_classification"),
    "month": ("month", "monthly_revenue", "mom_growth_percent"),
    "week": ("week_of_year", "week_performance_tier"),
    "special_period": ("special_period",)}.items() for c in columns}


def scope(model: str, col: str):
    """The rows of ``model`` that a test of ``col`` looks at."""
    if model == "fact_seasonality_analysis" and col in GRAIN_OF:
        return F.col("grain") == GRAIN_OF[col]
    return F.lit(True)


def _row_tests(kinds=("not_null", "accepted_values")) -> dict[str, list[tuple[str, str, Column]]]:
    """Per model the tests that one row alone decides: (kind, column, whether the row fails)."""
    out: dict[str, list] = {}
    if "not_null" in kinds:
        for model, cols in NOT_NULL.items():
            out.setdefault(model, []).extend(("not_null", c, scope(model, c) & F.col(c).isNull()) for c in cols)
    if "accepted_values" in kinds:
        for model, c, values in ACCEPTED:
            out.setdefault(model, []).append(("accepted_values", c, scope(model, c) & ~F.col(c).isin(*values)))
    return out


def row_test_results(models: dict[str, DataFrame], kinds=("not_null", "accepted_values")) -> DataFrame:
    """Failures of every NULL and domain test: one aggregate over each model,
    unpivoted. A NULL passes a domain test, like SQL NOT IN."""
    parts = []
    for model, tests in _row_tests(kinds).items():
        row = models[model].agg(*[F.count_if(bad).alias(f"t{i}") for i, (_, _, bad) in enumerate(tests)])
        labels = ", ".join(f"'{kind}', '{c}', t{i}" for i, (kind, c, _) in enumerate(tests))
        parts.append(row.select(F.lit(model).alias("model"), F.expr(f"stack({len(tests)}, {labels}) as (test_type, column_name, failures)")))
    return union_all(parts).select("test_type", "model", "column_name", "failures")


def test_not_null(models: dict[str, DataFrame]) -> DataFrame:
    """NULL count per tested column."""
    return row_test_results(models, ("not_null",))


def test_accepted_values(models: dict[str, DataFrame]) -> DataFrame:
    """Rows whose value is outside the list (NULL passes, like SQL NOT IN)."""
    return row_test_results(models, ("accepted_values",))


def _values(df: DataFrame, col: str, *tags: str) -> DataFrame:
    """The non-NULL values of a column as text, with constant tags before them."""
    named = [F.lit(t).alias(n) for n, t in zip(("domain", "model", "column_name"), tags)]
    return df.select(*named, F.col(col).cast("string").alias("value")).where("value IS NOT NULL")


def _with_zeros(spark, kind: str, tests: list[tuple[str, str]], failing: DataFrame) -> DataFrame:
    """A row for every test, 0 where nothing failed."""
    every = spark.createDataFrame(tests, "model string, column_name string")
    return every.join(failing, ["model", "column_name"], "left").select(
        F.lit(kind).alias("test_type"), "model", "column_name", F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures"))


def orphaned_values(models: dict[str, DataFrame]) -> DataFrame:
    """(domain, model, column_name, value, n): child values that their parent
    column lacks and the rows that hold them. All relationships are one anti
    join of tagged values; each side is counted or made distinct first, so a
    value of many rows is one row in the join."""
    children = union_all([_values(models[child], col, f"{parent}.{field}", child, col) for child, col, parent, field in RELATIONSHIPS])
    parents = union_all([_values(models[parent], field, f"{parent}.{field}") for parent, field in dict.fromkeys((p, f) for _, _, p, f in RELATIONSHIPS)])
    held = children.groupBy("domain", "model", "column_name", "value").agg(F.count("*").alias("n"))
    return held.join(parents.distinct(), ["domain", "value"], "left_anti")


def test_relationships(models: dict[str, DataFrame]) -> DataFrame:
    """Rows per child column whose (non-NULL) value the parent column lacks."""
    failing = orphaned_values(models).groupBy("model", "column_name").agg(F.sum("n").alias("failures"))
    return _with_zeros(next(iter(models.values())).sparkSession, "relationships", [(m, c) for m, c, _, _ in RELATIONSHIPS], failing)


def repeated_values(models: dict[str, DataFrame]) -> DataFrame:
    """(model, column_name, value, n): key values that several rows of a model hold, by one aggregate over all models."""
    keys = union_all([models[m].select(F.lit(m).alias("model"), F.lit(k).alias("column_name"), F.col(k).cast("string").alias("value")) for m, k in UNIQUE.items()])
    return keys.groupBy("model", "column_name", "value").agg(F.count("*").alias("n")).where("n > 1")


def column_results(models: dict[str, DataFrame]) -> DataFrame:
    """All column tests: (test_type, model, column_name, failures)."""
    return union_all([row_test_results(models), test_relationships(models), test_unique(models)])


def failing_rows(models: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The rows that fail a column test: test_name, model and the row as JSON
    (one table for models of any columns). A row that fails several tests
    comes once for each. ``limit`` keeps so many rows of each test, by their text."""
    name = lambda kind, model, col: "_".join((kind, model, col))
    whole = F.to_json(F.struct("*")).alias("row")
    parts = []
    for model, tests in _row_tests().items():
        failed = F.array_compact(F.array(*[F.when(bad, F.lit(name(kind, model, c))) for kind, c, bad in tests]))
        rows = models[model].select(F.lit(model).alias("model"), whole, failed.alias("failed")).where(F.size("failed") > 0)
        parts.append(rows.select(F.explode("failed").alias("test_name"), "model", "row"))
    keyed: dict[tuple[str, str, str], None] = dict.fromkeys(("unique", m, k) for m, k in UNIQUE.items())
    keyed |= dict.fromkeys(("relationships", m, c) for m, c, _, _ in RELATIONSHIPS)
    bad = {"unique": repeated_values(models).select("model", "column_name", "value"), "relationships": orphaned_values(models).select("model", "column_name", "value")}
    for kind in bad:
        rows = union_all([models[m].select(F.lit(m).alias("model"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), whole)
                          for k, m, c in keyed if k == kind])
        rows = rows.join(bad[kind].distinct(), ["model", "column_name", "value"], "left_semi") if kind == "relationships" else _semi_null_safe(rows, bad[kind])
        parts.append(rows.select(F.concat_ws("_", F.lit(kind), "model", "column_name").alias("test_name"), "model", "row"))
    out = union_all(parts)
    if limit is None:
        return out
    place = F.row_number().over(Window.partitionBy("test_name").orderBy("row"))
    return out.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def _semi_null_safe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (model, column_name, value) stands in ``keys``; NULL equals NULL."""
    k = keys.select(F.struct("model", "column_name", "value").alias("_k"))
    return rows.withColumn("_k", F.struct("model", "column_name", "value")).join(k, "_k", "left_semi").drop("_k")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n_records")).filter(F.col("n_records") > 1)


def test_unique(models: dict[str, DataFrame]) -> DataFrame:
    """Key values of each model that more than one row holds (NULL counts as a value)."""
    failing = repeated_values(models).groupBy("model", "column_name").agg(F.count("*").alias("failures"))
    return _with_zeros(next(iter(models.values())).sparkSession, "unique", list(UNIQUE.items()), failing)


# The aggregate tests, their severity and their bad-row counters.
AGGREGATE_TESTS = [
    ("test_campaign_performance_data_quality", "warn", "dq_campaign",
     ["null_campaign_ids", "null_network_ids", "null_platform_ids", "negative_revenue", "negative_spend",
      "negative_roas"]),
    ("test_spend_data_consistency", "warn", "dq_spend",
     ["null_spend_ids", "null_dates", "negative_spend", "invalid_platforms"]),
    ("test_user_data_quality", "warn", "dq_users",
     ["null_user_ids", "null_adids", "null_install_dates", "invalid_platforms", "invalid_tracking_status"]),
    ("test_referential_integrity", "error", "dq_referential",
     ["orphaned_campaigns", "orphaned_networks", "orphaned_platforms"]),
    ("test_campaign_performance_tier_logic", "warn", "dq_tiers",
     ["invalid_roas_tiers", "invalid_revenue_tiers", "invalid_actions"]),
    ("test_date_dimension_completeness", "warn", "dq_date_dim", ["null_day_of_week", "null_seasons"]),
    ("test_fact_campaign_daily_partitioning", "warn", "dq_daily_partitions", []),
    ("test_data_quality_score_calculation", "warn", "dq_score_logic", ["invalid_scores", "invalid_statuses"]),
]


def test_report(column_results: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """One row per test: name, severity, failures, status. Column tests warn;
    an aggregate test fails by the sum of its bad-row counters (not by its
    row count, which is always one)."""
    col = column_results.select(
        F.concat_ws("_", "test_type", "model", "column_name").alias("test_name"),
        F.lit("warn").alias("severity"), F.col("failures").cast("bigint").alias("failures"))
    parts = [col]
    for name, severity, check, bad in AGGREGATE_TESTS:
        total = reduce(lambda a, b: a + b, [F.col(c) for c in bad]) if bad else F.lit(0)
        parts.append(checks[check].select(F.lit(name).alias("test_name"), F.lit(severity).alias("severity"),
                                          total.cast("bigint").alias("failures")))
    r = union_all(parts)
    status = (F.when(F.col("failures") == 0, "pass")
              .when(F.col("severity") == "error", "fail").otherwise("warn"))
    return r.withColumn("status", status)


def store_failures(violations: DataFrame, order_by: list[str], limit: int | None = None) -> DataFrame:
    """Failing rows kept for inspection: all of them, or the first ``limit`` by
    a unique key (a distributed top-k) where a report asks for so many."""
    return violations if limit is None else violations.orderBy(*order_by).limit(limit)


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key value occurs more than once (semi join against the
    duplicated keys, which are at most half the rows)."""
    dups = duplicate_keys(df, key)
    return df.join(dups, key, "inner")


def history(scores: DataFrame) -> DataFrame:
    """Recorded quality scores of all runs, the latest first."""
    return scores.orderBy(F.desc("created_at"), "check_type", "table_name")
