"""Seasonality over the enriched daily fact: five long tables, the seasonality
fact of all their rows, and the wide table's statistics.

The model compares each group's average daily ROAS with the platform's
average over *daily rows* through a correlated subquery inside a grouped
SELECT; here one pass over the daily rows (``measures``) carries sums and
counts from which every table and the platform's average add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key

# Index bands, week tiers and special periods of the model.
INDEX_BANDS_SEASON = [(120, "Peak Season"), (100, "Good Season"), (80, "Average Season")]
INDEX_LOW_SEASON = "Low Season"
INDEX_BANDS_DAY = [(120, "Best Day"), (100, "Good Day"), (80, "Average Day")]
INDEX_LOW_DAY = "Poor Day"
WEEK_HIGH, WEEK_LOW = 1.2, 0.8
WEEKEND_DAYS = ("Saturday", "Sunday")


# Key columns of the five long tables, by grain.
GRAINS = {"season": ["network_name", "campaign_name", "season"], "day_of_week": ["day_of_week"], "month": ["month"],
          "week": ["week_of_year"], "special_period": ["special_period"]}
_CELL = ["platform", "network_name", "campaign_name", "season"]
_DAY = ["platform", "date", "year", "month", "day_of_week", "week_of_year", "special_period"]


def measures(dp: DataFrame) -> DataFrame:
    """Counts and sums of the daily rows by campaign cell and season, and by
    platform and day, in one pass (grouping sets over one scan of the daily
    fact, which holds one row per day and cell). All five tables add up from
    these rows; ``usual`` is the platform's average daily ROAS."""
    dp = dp.withColumn("special_period", special_period())
    for c in _DAY:
        if c not in dp.columns:
            dp = dp.withColumn(c, F.lit(None).cast("int"))
    keys = list(dict.fromkeys([*_CELL, *_DAY]))
    g = dp.groupingSets([[F.col(c) for c in _CELL], [F.col(c) for c in _DAY]], *[F.col(c) for c in keys]).agg(
        F.grouping("season").alias("by_day"), F.count("*").alias("n"), F.sum("daily_revenue").alias("revenue"),
        F.sum("daily_spend").alias("spend"), F.sum("daily_users").alias("users"), F.sum("daily_roas").alias("roas"),
        F.sum("daily_arpu").alias("arpu"))
    of = Window.partitionBy("platform")  # over the sums: a row per cell and season or per day
    by_day = F.col("by_day") == 1
    return g.withColumn("usual", F.sum(F.when(by_day, F.col("roas"))).over(of) / F.sum(F.when(by_day, F.col("n"))).over(of))


def _days(m: DataFrame) -> DataFrame:
    return m.where(F.col("by_day") == 1)


def _mean(c: str):
    return F.sum(c) / F.sum("n")


def _index(avg_col: str):
    """round(avg / platform avg * 100, 2) when avg > 0, else 100."""
    ratio = F.col(avg_col) / F.nullif(F.col("usual"), F.lit(0.0))
    return F.when(F.col(avg_col) > 0, F.round(ratio * 100, 2)).otherwise(F.lit(100.0))


def _band(col: str, bands, low):
    c = F.col(col)
    out = F.when(c >= bands[0][0], bands[0][1])
    for thr, label in bands[1:]:
        out = out.when(c >= thr, label)
    return out.otherwise(low)


def seasonal_patterns(m: DataFrame) -> DataFrame:
    g = m.where(F.col("by_day") == 0).select(
        *_CELL, F.col("n").alias("days_in_season"), F.col("revenue").alias("seasonal_revenue"),
        F.col("spend").alias("seasonal_spend"), (F.col("roas") / F.col("n")).alias("avg_seasonal_roas"),
        (F.col("arpu") / F.col("n")).alias("avg_seasonal_arpu"), F.col("users").alias("seasonal_users"), "usual")
    g = g.withColumn("seasonal_performance_index", _index("avg_seasonal_roas")).drop("usual")
    return g.withColumn("season_classification", _band("seasonal_performance_index", INDEX_BANDS_SEASON, INDEX_LOW_SEASON))


def dow_patterns(m: DataFrame) -> DataFrame:
    g = _days(m).groupBy("platform", "day_of_week").agg(
        F.count("*").alias("occurrences"), _mean("revenue").alias("avg_daily_revenue"),
        _mean("roas").alias("avg_daily_roas"), _mean("arpu").alias("avg_daily_arpu"),
        F.sum("users").alias("total_users"), F.max("usual").alias("usual"))
    g = g.withColumn("dow_performance_index", _index("avg_daily_roas")).drop("usual")
    return g.withColumn("day_classification", _band("dow_performance_index", INDEX_BANDS_DAY, INDEX_LOW_DAY))


def monthly_trends(m: DataFrame, by_year: bool = False) -> DataFrame:
    """Month-over-month growth. The model groups by month number alone (years
    fold together); ``by_year=True`` keys by (year, month) instead. The lag
    window runs over the monthly aggregate (<= 12 rows per platform-year)."""
    keys = ["platform", "year", "month"] if by_year else ["platform", "month"]
    g = _days(m).groupBy(*keys).agg(
        F.count("*").alias("days_in_month"), F.sum("revenue").alias("monthly_revenue"),
        F.sum("spend").alias("monthly_spend"), _mean("roas").alias("avg_monthly_roas"),
        _mean("arpu").alias("avg_monthly_arpu"), F.sum("users").alias("monthly_users"))
    w = Window.partitionBy("platform").orderBy(*keys[1:])
    g = g.withColumn("prev_month_revenue", F.lag("monthly_revenue").over(w))
    p = F.col("prev_month_revenue")
    return g.withColumn("mom_growth_percent",
                        F.when(p > 0, F.round((F.col("monthly_revenue") - p) / p * 100, 2)).otherwise(F.lit(0.0)))


def weekly_patterns(m: DataFrame) -> DataFrame:
    """``weeks_tracked`` counts distinct days, as in the model."""
    g = _days(m).groupBy("platform", "week_of_year").agg(
        F.count("*").alias("weeks_tracked"), _mean("revenue").alias("avg_weekly_revenue"),
        _mean("roas").alias("avg_weekly_roas"), F.max("usual").alias("usual"))
    a, base = F.col("avg_weekly_roas"), F.col("usual")
    tier = (F.when(a >= base * WEEK_HIGH, "High Performance Week")
            .when(a <= base * WEEK_LOW, "Low Performance Week").otherwise("Average Week"))
    return g.select("platform", "week_of_year", "weeks_tracked", "avg_weekly_revenue", "avg_weekly_roas",
                    tier.alias("week_performance_tier"))


def special_period():
    m, d = F.col("month"), F.col("day_of_week")
    weekend = d.isin(*WEEKEND_DAYS)
    return (F.when((m == 12) & weekend, "Holiday Season Weekend")
            .when(m == 12, "Holiday Season")
            .when((m == 11) & (d == "Friday"), "Black Friday Period")
            .when((m == 1) & weekend, "New Year Weekend")
            .when(m.isin(6, 7, 8) & weekend, "Summer Weekend")
            .otherwise("Regular Period"))


def special_periods(m: DataFrame) -> DataFrame:
    return _days(m).groupBy("platform", "special_period").agg(
        F.count("*").alias("days_in_period"), _mean("revenue").alias("avg_daily_revenue"),
        _mean("roas").alias("avg_daily_roas"), F.sum("users").alias("total_users"))


SIDES = ("seasonal", "dow", "month", "week", "special")


def seasonality_tables(m: DataFrame) -> dict[str, DataFrame]:
    """The five long tables from ``measures``."""
    return {"seasonal": seasonal_patterns(m), "dow": dow_patterns(m), "month": monthly_trends(m),
            "week": weekly_patterns(m), "special": special_periods(m)}


def seasonality_long(tables: dict[str, DataFrame]) -> DataFrame:
    """The seasonality fact: the rows of all five tables with their grain and
    an id each (the columns of other grains are NULL). The model joins the five
    on the platform alone, which repeats every row some 27,000 times."""
    renamed = {"dow": {"avg_daily_revenue": "dow_avg_revenue", "avg_daily_roas": "dow_avg_roas", "avg_daily_arpu": "dow_avg_arpu", "total_users": "dow_total_users"},
               "special": {"avg_daily_revenue": "special_avg_revenue", "avg_daily_roas": "special_avg_roas", "total_users": "special_total_users"}}
    parts = []
    for side, (grain, keys) in zip(SIDES, GRAINS.items()):
        part = tables[side].withColumnsRenamed(renamed.get(side, {}))
        key = surrogate_key(F.lit(grain), "platform", *keys)
        parts.append(part.select(key.alias("seasonality_id"), F.lit(grain).alias("grain"), *part.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def seasonality_wide_stats(m: DataFrame) -> DataFrame:
    """Statistics of the model's wide table per platform without building it.

    The wide table per platform is the product of five sides, so its row
    count is the product of the side counts, and a column of one side
    appears (product of the other counts) times per row of that side: its
    sum over the wide rows is its side sum times that product. Five small
    aggregates of ``measures`` replace a fan-out of ~27,000 x the seasonal
    rows. Reported: row and side counts, the day and user counters, and the
    revenue columns that are sums (seasonal, monthly)."""
    day = _days(m)
    parts = {
        "seasonal": m.where(F.col("by_day") == 0).groupBy("platform").agg(
            F.count("*").alias("n_seasonal"), F.sum("users").alias("s_seasonal_users"),
            F.sum("n").alias("s_days_in_season"), F.sum("revenue").alias("s_seasonal_revenue")),
        "dow": day.groupBy("platform").agg(
            F.count_distinct("day_of_week").alias("n_dow"), F.sum("users").alias("s_dow_users"),
            F.count("*").alias("s_occurrences")),
        "month": day.groupBy("platform").agg(
            F.count_distinct("month").alias("n_month"), F.sum("users").alias("s_monthly_users"),
            F.sum("revenue").alias("s_monthly_revenue")),
        "week": day.groupBy("platform").agg(
            F.count_distinct("week_of_year").alias("n_week"), F.count("*").alias("s_weeks_tracked")),
        "special": day.groupBy("platform").agg(
            F.count_distinct("special_period").alias("n_special"), F.sum("users").alias("s_special_users")),
    }
    j = parts["seasonal"]
    for side in SIDES[1:]:
        j = j.join(parts[side], "platform")
    n = {s: F.col(f"n_{s}") for s in SIDES}

    def others(side):
        out = F.lit(1).cast("bigint")
        for s in SIDES:
            if s != side:
                out = out * n[s]
        return out

    rows = n["seasonal"] * n["dow"] * n["month"] * n["week"] * n["special"]
    return j.select(
        "platform",
        rows.alias("wide_rows"),
        *[n[s].alias(f"n_{s}") for s in SIDES],
        (F.col("s_seasonal_users") * others("seasonal")).alias("sum_seasonal_users"),
        (F.col("s_days_in_season") * others("seasonal")).alias("sum_days_in_season"),
        (F.col("s_dow_users") * others("dow")).alias("sum_dow_total_users"),
        (F.col("s_occurrences") * others("dow")).alias("sum_occurrences"),
        (F.col("s_monthly_users") * others("month")).alias("sum_monthly_users"),
        (F.col("s_weeks_tracked") * others("week")).alias("sum_weeks_tracked"),
        (F.col("s_special_users") * others("special")).alias("sum_special_total_users"),
        (F.col("s_seasonal_revenue") * others("seasonal")).alias("sum_seasonal_revenue"),
        (F.col("s_monthly_revenue") * others("month")).alias("sum_monthly_revenue"),
    )
