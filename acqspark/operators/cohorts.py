"""Install cohorts: LTV table and the retention triangle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key, adjusted_revenue, month_start, month_index

# LTV projection multipliers (3, 6, 12 months).
LTV_MULTIPLIERS = {"ltv_3m_projected": 1.5, "ltv_6m_projected": 2.0, "ltv_12m_projected": 2.5}


def cohort_ltv(stg_users: DataFrame) -> DataFrame:
    """Per install month x platform: size, revenue, ARPU, LTV projections,
    retention and a quality score.

    The model's cohort month is the month of each install row, and its
    "activity month" is the same value, so the latest month index is always 0
    and the retention rate is active/size = 100 for every non-empty cohort.
    That literal value is kept; ``cohort_retention`` is the real triangle."""
    u = stg_users.select("adid", "platform", "install_date",
                         month_start("install_date").alias("cohort_month"),
                         adjusted_revenue("lower", null_as_zero=False).alias("adjusted_revenue"))
    g = u.groupBy("cohort_month", "platform").agg(
        F.count_distinct("adid").alias("cohort_size"),
        F.sum("adjusted_revenue").alias("total_cohort_revenue"),
        F.avg("adjusted_revenue").alias("initial_arpu"),
        F.min("install_date").alias("cohort_start_date"),
        F.max("install_date").alias("cohort_end_date"))
    ltv = F.col("total_cohort_revenue") / F.col("cohort_size")
    # active users at the latest month index == cohort_size (see docstring)
    retention = F.round(F.col("cohort_size").cast("double") / F.col("cohort_size").cast("double") * 100, 2)
    g = g.select("*", ltv.alias("ltv_current"), *[(ltv * m).alias(n) for n, m in LTV_MULTIPLIERS.items()],
                 retention.alias("retention_rate"))
    score = (F.when(F.col("ltv_current") > 5.0, 40).otherwise(0) + F.when(F.col("retention_rate") > 30, 30).otherwise(0)
             + F.when(F.col("total_cohort_revenue") > 10000, 20).otherwise(0)
             + F.when(F.col("cohort_size") > 1000, 10).otherwise(0))
    return g.select(
        surrogate_key("cohort_month", "platform").alias("cohort_analysis_id"),
        "cohort_month", "platform", "cohort_size", "total_cohort_revenue", "initial_arpu", "ltv_current",
        *LTV_MULTIPLIERS, "retention_rate", "cohort_start_date", "cohort_end_date",
        score.alias("cohort_quality_score"))


def cohort_retention(stg_users: DataFrame) -> DataFrame:
    """Cohort = month of a device's first install; for each later month with
    installs, active devices, revenue, and the share of the cohort.

    The installs are first summed per device, platform and month (a partial
    aggregate), so the windows per device see no more rows than it has months
    and platforms, however often it installs. A device counts towards its
    cohort's size once per platform. Rows without a device, a platform or a
    first month belong to no cohort."""
    u = stg_users.select("adid", "platform", month_start("install_date").alias("activity_month"),
                         adjusted_revenue("lower", null_as_zero=False).alias("adjusted_revenue"))
    u = u.filter(F.col("adid").isNotNull())
    per_device = u.groupBy("adid", "platform", "activity_month").agg(F.sum("adjusted_revenue").alias("adjusted_revenue"))
    months = Window.partitionBy("adid", "platform").orderBy("activity_month")
    placed = (per_device
              .withColumn("cohort_month", F.min("activity_month").over(Window.partitionBy("adid")))
              .withColumn("is_first", (F.row_number().over(months) == 1).cast("bigint"))
              .filter(F.col("cohort_month").isNotNull() & F.col("platform").isNotNull())
              .withColumn("months_since_install", (month_index("activity_month") - month_index("cohort_month")).cast("int")))
    cells = placed.groupBy("cohort_month", "platform", "months_since_install").agg(
        F.count("*").alias("active_users"),
        F.sum("adjusted_revenue").alias("cohort_revenue"),
        F.sum("is_first").alias("first_users"))
    # a cohort has one cell per month, so this window is small
    size = F.sum("first_users").over(Window.partitionBy("cohort_month", "platform"))
    return (cells.withColumn("cohort_size", size)
            .select("cohort_month", "platform", "months_since_install", "active_users", "cohort_size",
                    F.round(F.col("active_users") / F.col("cohort_size") * 100, 2).alias("retention_rate"),
                    "cohort_revenue"))
