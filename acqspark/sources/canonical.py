"""The two input tables of the models, derived from the test tables.

``user_data`` (one row per install touchpoint) comes from ``events`` and
``spend`` (one row per spend line) from ``orders``; ``src_id`` is the unique
source row id used as the final tie-break wherever an order is needed.
The DataFrame builders below and the SQL text in ``CANON_CTES`` define the
same two relations; the SQL is what the DuckDB oracles run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The canonical derivation (must stay identical to the SQL below).
NETWORKS = ("Network A", "Network B", "Network C")
PRIORITY_CAMPAIGN = {
    "1-URGENT": "campaign_click",
    "2-HIGH": "campaign_view",
    "3-MEDIUM": "campaign_purchase",
    "4-NOT SPECIFIED": "campaign_signup",
}
PRIORITY_DIVISOR = {"1-URGENT": 1500, "2-HIGH": 4000, "3-MEDIUM": 8000, "4-NOT SPECIFIED": 15000}
OTHER_CAMPAIGN = "campaign_error"
OTHER_DIVISOR = 25000
SPEND_START = "2024-01-01"
SPEND_DAYS = 210


def _network(k) -> F.Column:
    m = k % 3
    return (F.when(m == 0, NETWORKS[0]).when(m == 1, NETWORKS[1]).otherwise(NETWORKS[2]))


def canon_user_data(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    uid, eid = F.col("user_id"), F.col("event_id")
    opt_out = uid % 4 == 1
    return e.select(
        eid.alias("src_id"),
        uid.cast("string").alias("adid"),
        F.when(uid % 2 == 0, "android").otherwise("ios").alias("platform"),
        F.date_add(F.to_date("ts"), (30 * (uid % 6) + 30 * (eid % 4)).cast("int")).alias("install_date"),
        F.concat(F.lit("campaign_"), F.col("event_type")).alias("campaign_name"),
        _network(eid).alias("network_name"),
        F.when(opt_out, F.lit(None).cast("double")).otherwise(F.col("value")).alias("revenue_usd"),
        F.when(opt_out & (eid % 50 != 0), (eid % 64).cast("int")).alias("cv_bucket"),
        F.when(uid % 2 == 0, F.lit(None).cast("string"))
         .when(opt_out, "Opt out").otherwise("Opt in").alias("tracking_status"),
    )


def canon_spend(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    pri = F.col("o_orderpriority")
    campaign = F.lit(OTHER_CAMPAIGN)
    divisor = F.lit(OTHER_DIVISOR)
    for p in reversed(list(PRIORITY_CAMPAIGN)):
        campaign = F.when(pri == p, PRIORITY_CAMPAIGN[p]).otherwise(campaign)
        divisor = F.when(pri == p, PRIORITY_DIVISOR[p]).otherwise(divisor)
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(0.0)).otherwise(F.col("o_totalprice") / divisor)
    return o.select(
        F.col("o_orderkey").alias("src_id"),
        F.date_add(F.lit(SPEND_START).cast("date"), (F.col("o_orderkey") % SPEND_DAYS).cast("int")).alias("date"),
        F.when(F.col("o_custkey") % 2 == 0, "android").otherwise("ios").alias("platform"),
        _network(F.col("o_custkey")).alias("network_name"),
        campaign.alias("campaign_name"),
        (F.floor(raw * 100) / 100).alias("spend"),
    )


# The same two relations as SQL common table expressions, used as the leading
# CTEs of every oracle query (the oracle engine registers only base tables).
CANON_CTES = """with user_data as (
select event_id as src_id, cast(user_id as string) as adid,
  case when user_id % 2 = 0 then 'android' else 'ios' end as platform,
  cast(cast(ts as date) + cast(30*(user_id % 6) + 30*(event_id % 4) as int) as date) as install_date,
  concat('campaign_', event_type) as campaign_name,
  case event_id % 3 when 0 then 'Network A' when 1 then 'Network B' else 'Network C' end as network_name,
  case when user_id % 4 = 1 then null else value end as revenue_usd,
  case when user_id % 4 = 1 and event_id % 50 <> 0 then cast(event_id % 64 as int) end as cv_bucket,
  case when user_id % 2 = 0 then null when user_id % 4 = 1 then 'Opt out' else 'Opt in' end as tracking_status
from events
),
spend as (
select o_orderkey as src_id,
  cast(date '2024-01-01' + cast(o_orderkey % 210 as int) as date) as date,
  case when o_custkey % 2 = 0 then 'android' else 'ios' end as platform,
  case o_custkey % 3 when 0 then 'Network A' when 1 then 'Network B' else 'Network C' end as network_name,
  case o_orderpriority when '1-URGENT' then 'campaign_click' when '2-HIGH' then 'campaign_view'
    when '3-MEDIUM' then 'campaign_purchase' when '4-NOT SPECIFIED' then 'campaign_signup' else 'campaign_error' end as campaign_name,
  floor(case when o_orderstatus = 'F' then 0.0 else o_totalprice /
    (case o_orderpriority when '1-URGENT' then 1500 when '2-HIGH' then 4000 when '3-MEDIUM' then 8000
      when '4-NOT SPECIFIED' then 15000 else 25000 end) end * 100) / 100 as spend
from orders
)"""
