"""Dimensions: distinct names with hash ids, and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import surrogate_key, day_name, season_of
from ..functions.dates import WEEKEND
from ..functions.metrics import as_date

# The calendar starts on this day at the latest and runs two years past as_of.
DATE_SPINE_START = "2024-01-01"
DATE_SPINE_YEARS = 2


def name_dim(source: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """DISTINCT names + md5 id. The key needs no ordering, so the distinct is
    the only shuffle (and it is tiny after partial aggregation)."""
    return (source.select(name_col).distinct()
            .select(surrogate_key(name_col).alias(id_col), F.col(name_col)))


def dim_campaign(metrics: DataFrame) -> DataFrame:
    return name_dim(metrics, "campaign_name", "campaign_id")


def dim_network(metrics: DataFrame) -> DataFrame:
    return name_dim(metrics, "network_name", "network_id")


def dim_platform(metrics: DataFrame) -> DataFrame:
    return name_dim(metrics, "platform", "platform_id")


def date_spine(spark: SparkSession, start, end_exclusive) -> DataFrame:
    """One row per day in [start, end_exclusive); bounds may be Columns."""
    s, e = as_date(start), as_date(end_exclusive)
    return spark.range(1).select(F.explode(F.sequence(s, F.date_sub(e, 1))).alias("date_day"))


def dim_date(spark: SparkSession, as_of, start=DATE_SPINE_START,
             years: int = DATE_SPINE_YEARS) -> DataFrame:
    """``start``: a day or a Column; the mart passes the first day of its
    inputs where that is earlier, so that no fact row lies before the spine."""
    spine = date_spine(spark, start, F.add_months(as_of_date(as_of), 12 * years))
    d = F.col("date_day")
    dow = day_name(d)
    return spine.select(
        surrogate_key(d).alias("date_id"),
        d.alias("date"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"),
        F.weekofyear(d).alias("week_of_year"),
        dow.alias("day_of_week"),
        F.when(dow.isin(*WEEKEND), "Weekend").otherwise("Weekday").alias("day_type"),
        season_of(F.month(d)).alias("season"),
    )


def as_of_date(as_of):
    return as_date(as_of).cast("date")
