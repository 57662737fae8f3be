"""Staging models: typed inputs plus hash keys, and the incremental-load filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key, money_key
from ..functions.metrics import as_date

SPEND_COLS = ["date", "platform", "network_name", "campaign_name", "spend"]
USER_COLS = ["adid", "platform", "install_date", "campaign_name", "network_name",
             "revenue_usd", "cv_bucket", "tracking_status"]
CAMPAIGN_METRIC_COLS = ["platform", "campaign_name", "network_name", "total_revenue", "total_users",
                        "conversion_rate", "total_spend", "roas", "arpu", "forecasted_revenue",
                        "high_roas", "high_roas_prob"]


def _with_src(df: DataFrame, cols: list[str]) -> list:
    return (["src_id"] if "src_id" in df.columns else []) + cols


def stg_spend(spend: DataFrame) -> DataFrame:
    """One row per spend line keyed by md5(date, platform, network, campaign, spend)."""
    key = surrogate_key("date", "platform", "network_name", "campaign_name", money_key("spend"))
    return spend.select(key.alias("spend_id"), *_with_src(spend, SPEND_COLS))


def stg_user_data(user_data: DataFrame) -> DataFrame:
    """One row per install touchpoint keyed by md5(adid, install_date, platform)
    (the key repeats when a device installs twice on a day; see ``dedupe_latest``)."""
    key = surrogate_key("adid", "install_date", "platform")
    return user_data.select(key.alias("user_id"), *_with_src(user_data, USER_COLS))


def stg_campaign_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select(*CAMPAIGN_METRIC_COLS)


def high_water_mark(target: DataFrame, col: str) -> Column:
    """max(col) of the target as an uncorrelated scalar subquery (stays lazy)."""
    return target.agg(F.max(col)).scalar()


def after_high_water(source: DataFrame, target: DataFrame, col: str, lookback_days: int = 0) -> DataFrame:
    """Rows of ``source`` strictly after the target's high-water mark.
    An empty target (NULL mark) loads everything; ``lookback_days`` re-reads
    that many days before the mark so late rows are not dropped."""
    mark = high_water_mark(target, col)
    if lookback_days:
        mark = F.date_sub(mark, lookback_days)
    return source.filter((F.col(col) > mark) | mark.isNull())


def dedupe_latest(df: DataFrame, key: str, order_col: str = "src_id") -> DataFrame:
    """Keep one row per key, the one with the highest ``order_col``.
    ``row_number() == 1`` lets Spark insert a partial WindowGroupLimit before
    the shuffle: each map task forwards at most one row per key, so a key
    with very many copies is collapsed map-side, like a partial aggregate."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """MERGE by unique key: rows of ``target`` whose key is not in ``source``,
    plus all of ``source``. ``source`` must already be unique on ``key``."""
    keep = target.join(source.select(key), key, "left_anti")
    return keep.unionByName(source)


def _incremental(staged: DataFrame, date_col: str, cut, lookback_days: int) -> DataFrame:
    """The previous build plus the rows after its high-water mark. The
    surrogate key isn't unique per source row, so nothing is deduplicated by
    it; with ``lookback_days`` the re-read days replace what was built."""
    previous = staged.filter(F.col(date_col) <= as_date(cut))
    batch = after_high_water(staged, previous, date_col, lookback_days)
    if lookback_days:
        kept_until = F.date_sub(high_water_mark(previous, date_col), lookback_days)
        previous = previous.filter(F.col(date_col) <= kept_until)
    return previous.unionByName(batch)


def incremental_stg_spend(spend: DataFrame, cut, lookback_days: int = 0) -> DataFrame:
    """State of stg_spend after an incremental run: the previous build holds the
    rows up to ``cut``; the run loads rows after its high-water mark and appends them."""
    return _incremental(stg_spend(spend), "date", cut, lookback_days)


def incremental_stg_user_data(user_data: DataFrame, cut, lookback_days: int = 0) -> DataFrame:
    return _incremental(stg_user_data(user_data), "install_date", cut, lookback_days)
