"""Incremental processing as pure functions: the 7-day reprocess window and
the MERGE of recomputed daily rows into an existing daily fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .daily import daily_spend, daily_users, spend_user_full_outer, campaign_daily
from .staging import upsert

REPROCESS_DAYS = 7


def daily_window(stg_spend: DataFrame, stg_users: DataFrame, dims: dict, as_of,
                 days: int = REPROCESS_DAYS) -> DataFrame:
    """The daily fact recomputed for [as_of - days, as_of] only. The window
    filter sits below both aggregates, so it reaches the staging scans (and
    prunes partitions when staging is stored partitioned by date)."""
    s = daily_spend(stg_spend, as_of, days)
    u = daily_users(stg_users, as_of, days)
    return campaign_daily(spend_user_full_outer(s, u), dims["campaign"], dims["network"], dims["platform"],
                          dims["date"])


def merge_daily(target: DataFrame, recomputed: DataFrame) -> DataFrame:
    """MERGE by campaign_daily_id: recomputed rows replace or add, the rest of
    the target is kept."""
    return upsert(target, recomputed.select(*target.columns), "campaign_daily_id")
