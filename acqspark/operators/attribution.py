"""Multi-touch attribution: touchpoint order per device, five credit models.

Order of a device's touchpoints is (install_date, campaign_name, src_id);
src_id breaks the ties the model's (install_date, campaign_name) leaves. NULL
sorts first; rows without a device count as the touchpoints of one device.

Skew: a device may hold a third of all rows. Its order is therefore found in
two levels, by the same plan for every device: rows are cut into blocks (device,
install_date, campaign_name, src_id div BLOCK_IDS), at most BLOCK_IDS rows each,
ranked inside their block, and shifted by the rows of the device's earlier
blocks, which a window over the counts of blocks gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import surrogate_key, adjusted_revenue

KEYS = ["platform", "campaign_name", "network_name"]
TOUCH_ORDER = ["install_date", "campaign_name", "src_id"]
# Source ids in one block: the most rows that one task ranks together.
BLOCK_IDS = 1 << 20
# Position-based weights and the recommendation labels.
POS_FIRST, POS_LAST, POS_MIDDLE = 0.4, 0.4, 0.2
LABEL_POSITION = "Position-based (assisted conversions important)"
LABEL_LINEAR = "Linear (multi-touch journey common)"
LABEL_DECAY = "Time-decay (recent interactions matter)"
LABEL_LAST = "Last-touch (direct response dominant)"


def rank_within(df: DataFrame, key: str, order: list[str], block_ids: int = BLOCK_IDS,
                order_col: str = "touchpoint_order", count_col: str = "touchpoint_count",
                sums: dict | None = None) -> DataFrame:
    """row_number() and count() per ``key`` ordered by ``order``, whose last
    column is an integer id unique within a key, plus per-key sums of the
    ``sums`` columns (name -> source column). A key's rows are never brought
    into one task, only its blocks' counts are."""
    sums = sums or {}
    *coarse, ident = order
    # Compared as one struct, NULL parts are equal to each other.
    block = F.struct(F.col(key).alias("key"), *[F.col(c) for c in coarse],
                     F.floor(F.col(ident) / block_ids).alias("block"))
    rows = df.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"), *[F.sum(src).alias(f"_{name}") for name, src in sums.items()])
    device = Window.partitionBy("_block.key").orderBy("_block")
    earlier = device.rowsBetween(Window.unboundedPreceding, -1)
    device = device.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = counts.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_n").over(device).alias(count_col),
                           *[F.sum(f"_{name}").over(device).alias(name) for name in sums])
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_block").orderBy(ident)))
    return (ranked.join(blocks, "_block")
            .withColumn(order_col, (F.col("_before") + F.col("_place")).cast("int"))
            .drop("_block", "_before", "_place"))


def touchpoints(stg_users: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Installs with campaign and network, the lower-bound revenue estimate
    (NULL bucket stays NULL), touchpoint order and count per device."""
    t = (stg_users.filter(F.col("campaign_name").isNotNull() & F.col("network_name").isNotNull())
         .select("src_id", "adid", "platform", "install_date", "campaign_name", "network_name", "revenue_usd",
                 adjusted_revenue("lower", null_as_zero=False).alias("adjusted_revenue")))
    r = rank_within(t, "adid", TOUCH_ORDER, block_ids, sums={"device_revenue": "adjusted_revenue"})
    return r.select(*t.columns, "touchpoint_order", F.col("touchpoint_count").cast("bigint").alias("touchpoint_count"),
                    "device_revenue")


def _o():
    return F.col("touchpoint_order")


def _n():
    return F.col("touchpoint_count")


def _r():
    return F.col("adjusted_revenue")


def _dr():
    return F.col("device_revenue")


# Credit of one touchpoint under each model: the literal model weights applied
# to the touchpoint's own revenue, and normalized variants that split the
# device's total revenue with weights summing to 1 (so they hand out exactly
# the total revenue).
def credit_linear():
    return _r() / _o()


def credit_linear_norm():
    return _dr() / _n()


def credit_time_decay():
    return _r() * (_o().cast("double") / _n())


def credit_time_decay_norm():
    return _dr() * (_o().cast("double") / (_n() * (_n() + 1) / 2))


def credit_position():
    return (F.when(_o() == 1, _r() * POS_FIRST).when(_o() == _n(), _r() * POS_LAST)
            .otherwise(_r() * POS_MIDDLE))


def credit_position_norm():
    return (F.when(_n() == 1, _dr())
            .when(_n() == 2, _dr() * 0.5)
            .when((_o() == 1) | (_o() == _n()), _dr() * POS_FIRST)
            .otherwise(_dr() * (POS_MIDDLE / (_n() - 2))))


def _is_first():
    return _o() == 1


def _is_last():
    return _o() == _n()


def first_touch(tp: DataFrame) -> DataFrame:
    """Groups with a first touch; each device has exactly one, so the distinct
    user count is a plain count of first-touch rows (no distinct aggregate)."""
    return (tp.filter(_is_first()).groupBy(*KEYS)
            .agg(F.count("*").alias("first_touch_users"), F.sum(_r()).alias("first_touch_revenue")))


def last_touch(tp: DataFrame) -> DataFrame:
    return (tp.filter(_is_last()).groupBy(*KEYS)
            .agg(F.count("*").alias("last_touch_users"), F.sum(_r()).alias("last_touch_revenue")))


def _all_rows(tp: DataFrame, prefix: str, credit) -> DataFrame:
    return (tp.groupBy(*KEYS)
            .agg(F.count_distinct("adid").alias(f"{prefix}_users"), F.sum(credit).alias(f"{prefix}_revenue")))


def linear(tp):
    return _all_rows(tp, "linear", credit_linear())


def linear_norm(tp):
    return _all_rows(tp, "linear_norm", credit_linear_norm())


def time_decay(tp):
    return _all_rows(tp, "time_decay", credit_time_decay())


def time_decay_norm(tp):
    return _all_rows(tp, "time_decay_norm", credit_time_decay_norm())


def position(tp):
    return _all_rows(tp, "position", credit_position())


def position_norm(tp):
    return _all_rows(tp, "position_norm", credit_position_norm())


def attribution_all(tp: DataFrame, spend_by_cell: DataFrame) -> DataFrame:
    """All five models in ONE aggregation over the touchpoints, plus spend.

    Linear, time-decay and position group over every touchpoint, so their
    key set contains the first/last-touch keys: one conditional aggregation
    equals the combination of the five per-model tables. Users and revenue
    default to 0, ROAS to 0; the label rules see the NULL-able sums."""
    g = tp.groupBy(*KEYS).agg(
        F.count_if(_is_first()).alias("first_touch_users"),
        F.sum(F.when(_is_first(), _r())).alias("ft_rev"),
        F.count_if(_is_last()).alias("last_touch_users"),
        F.sum(F.when(_is_last(), _r())).alias("lt_rev"),
        F.count_distinct("adid").alias("users"),
        F.sum(credit_linear()).alias("la_rev"),
        F.sum(credit_time_decay()).alias("td_rev"),
        F.sum(credit_position()).alias("pb_rev"),
    )
    j = g.join(spend_by_cell, KEYS, "left")
    spend = F.col("total_spend")

    def roas(c):
        return F.when(spend > 0, F.coalesce(F.col(c), F.lit(0.0)) / spend).otherwise(0.0)

    ft, lt, la, td = F.col("ft_rev"), F.col("lt_rev"), F.col("la_rev"), F.col("td_rev")
    label = (F.when((ft + lt) > la * 2, LABEL_POSITION)
             .when(la > lt * 1.5, LABEL_LINEAR)
             .when(td > lt * 1.2, LABEL_DECAY)
             .otherwise(LABEL_LAST))
    z = F.lit(0.0)
    return j.select(
        surrogate_key("campaign_name", "network_name", "platform").alias("attribution_id"),
        *KEYS,
        "first_touch_users", F.coalesce(ft, z).alias("first_touch_revenue"), roas("ft_rev").alias("first_touch_roas"),
        "last_touch_users", F.coalesce(lt, z).alias("last_touch_revenue"), roas("lt_rev").alias("last_touch_roas"),
        F.col("users").alias("linear_users"), F.coalesce(la, z).alias("linear_revenue"),
        roas("la_rev").alias("linear_roas"),
        F.col("users").alias("time_decay_users"), F.coalesce(td, z).alias("time_decay_revenue"),
        roas("td_rev").alias("time_decay_roas"),
        F.col("users").alias("position_users"), F.coalesce("pb_rev", z).alias("position_revenue"),
        roas("pb_rev").alias("position_roas"),
        label.alias("recommended_model"),
    )
