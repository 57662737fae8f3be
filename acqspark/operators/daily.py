"""Daily campaign fact: spend and installs aggregated per day, then combined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import surrogate_key, safe_ratio, adjusted_revenue, money_sum
from ..functions.metrics import as_date

DAY_KEYS = ["date", "platform", "network_name", "campaign_name"]
DAILY_COLS = ["campaign_daily_id", "campaign_id", "network_id", "platform_id", "date_id", "date",
              "daily_users", "daily_revenue", "daily_spend", "daily_roas", "daily_arpu"]


def in_window(date_col: str, as_of, days: int | None):
    """``as_of - days <= date <= as_of`` (no upper bound would let rows dated
    after ``as_of`` in, since the source models assumed nothing lies after today)."""
    if days is None:
        return F.lit(True)
    a = as_date(as_of)
    c = F.col(date_col)
    return (c >= F.date_sub(a, days)) & (c <= a)


def revenue_adjusted(stg_users: DataFrame) -> DataFrame:
    """Per-install revenue with the opt-out lower-bound estimate, both NULL modes."""
    return stg_users.select(
        "src_id", "adid", "platform", "install_date", "campaign_name", "network_name",
        adjusted_revenue("lower", null_as_zero=True).alias("adjusted_revenue"),
        adjusted_revenue("lower", null_as_zero=False).alias("adjusted_revenue_nullable"),
    )


def daily_spend(stg_spend: DataFrame, as_of=None, window_days: int | None = None) -> DataFrame:
    """sum(spend) per day x platform x network x campaign. The optional
    reprocess window is applied before the aggregate, so it reaches the scan."""
    s = stg_spend.filter(in_window("date", as_of, window_days)) if window_days is not None else stg_spend
    return s.groupBy(*DAY_KEYS).agg(money_sum("spend").alias("daily_spend"))


def daily_users(stg_users: DataFrame, as_of=None, window_days: int | None = None,
                approx_rsd: float | None = None) -> DataFrame:
    """count(distinct adid) and adjusted revenue per install day and campaign.
    One distinct aggregate per groupBy: Spark plans it as two partial
    aggregations, so a device with many rows is collapsed map-side.
    ``approx_rsd`` switches to a HyperLogLog++ sketch (one partial
    aggregation, fixed memory per group) with that relative error."""
    u = stg_users.filter(in_window("install_date", as_of, window_days)) if window_days is not None else stg_users
    users = (F.count_distinct("adid") if approx_rsd is None
             else F.approx_count_distinct("adid", approx_rsd))
    return (u.withColumnRenamed("install_date", "date")
            .groupBy(*DAY_KEYS)
            .agg(users.alias("daily_users"),
                 money_sum(adjusted_revenue("lower", null_as_zero=True)).alias("daily_revenue")))


def spend_user_full_outer(spend_daily: DataFrame, users_daily: DataFrame) -> DataFrame:
    """Full outer join on the four keys (USING join: keys are coalesced),
    zero-filled metrics, guarded ROAS and ARPU. Both sides are already unique
    on the join keys, so the join cannot fan out."""
    j = spend_daily.join(users_daily, on=DAY_KEYS, how="full")
    users = F.coalesce("daily_users", F.lit(0).cast("bigint"))
    rev = F.coalesce("daily_revenue", F.lit(0.0))
    spend = F.coalesce("daily_spend", F.lit(0.0))
    return j.select(
        *DAY_KEYS,
        users.alias("daily_users"), rev.alias("daily_revenue"), spend.alias("daily_spend"),
        safe_ratio(rev, spend).alias("daily_roas"),
        safe_ratio(rev, users).alias("daily_arpu"),
    )


CALENDAR_COLS = ["year", "month", "quarter", "day_of_week", "season", "week_of_year"]
ENRICHED_COLS = ["date", *CALENDAR_COLS, "platform", "network_name", "campaign_name", "daily_revenue",
                 "daily_spend", "daily_roas", "daily_arpu", "daily_users"]


def campaign_daily_named(combined: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
                         dim_platform: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Attach the dimension ids (inner joins, as the model does: names missing
    from a dimension drop out) and keep names and calendar attributes too,
    so the daily fact and its enriched view come from one join chain.
    Dimensions are distinct-name tables; AQE broadcasts them from their
    runtime size."""
    j = (combined
         .join(dim_campaign, "campaign_name")
         .join(dim_network, "network_name")
         .join(dim_platform, "platform")
         .join(dim_date.select("date", "date_id", *CALENDAR_COLS), "date"))
    key = surrogate_key("date", "campaign_id", "network_id", "platform_id")
    return j.select(key.alias("campaign_daily_id"), *DAILY_COLS[1:], *CALENDAR_COLS,
                    "platform", "network_name", "campaign_name")


def campaign_daily_by_name(combined: DataFrame, dim_date: DataFrame) -> DataFrame:
    """The same rows where the dimensions are built from the names of both
    inputs, as the mart's are: every name has its dimension row and the id is
    a function of the name, so the three joins would add nothing but a second
    reading of the inputs."""
    j = combined.where("campaign_name IS NOT NULL AND network_name IS NOT NULL AND platform IS NOT NULL")
    j = j.join(dim_date.select("date", "date_id", *CALENDAR_COLS), "date")
    j = j.withColumns({f"{d}_id": surrogate_key(name) for d, name in (("campaign", "campaign_name"), ("network", "network_name"), ("platform", "platform"))})
    key = surrogate_key("date", "campaign_id", "network_id", "platform_id")
    return j.select(key.alias("campaign_daily_id"), *DAILY_COLS[1:], *CALENDAR_COLS, "platform", "network_name", "campaign_name")


def campaign_daily(combined: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
                   dim_platform: DataFrame, dim_date: DataFrame) -> DataFrame:
    return campaign_daily_named(combined, dim_campaign, dim_network, dim_platform, dim_date).select(*DAILY_COLS)


def daily_enriched(daily: DataFrame, dim_campaign: DataFrame, dim_network: DataFrame,
                   dim_platform: DataFrame, dim_date: DataFrame) -> DataFrame:
    """A stored daily fact with calendar attributes and names, joined back by
    id (seasonality input). When the fact is built in the same plan,
    ``campaign_daily_named`` gives the same rows without the round trip."""
    dd = dim_date.select("date_id", *CALENDAR_COLS)
    j = (daily.join(dd, "date_id")
         .join(dim_platform, "platform_id")
         .join(dim_network, "network_id")
         .join(dim_campaign, "campaign_id"))
    return j.select(*ENRICHED_COLS)
