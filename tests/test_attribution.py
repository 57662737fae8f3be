import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acqspark.operators import attribution as attr

D = dt.date
SCHEMA = ("src_id bigint, adid string, platform string, install_date date, campaign_name string, "
          "network_name string, revenue_usd double, cv_bucket int, tracking_status string")
ROWS = [
    # device a: three touches, two tied on (date, campaign) -> src_id decides
    (1, "a", "android", D(2024, 1, 1), "c1", "n1", 10.0, None, None),
    (3, "a", "android", D(2024, 1, 2), "c2", "n1", 20.0, None, None),
    (2, "a", "android", D(2024, 1, 2), "c2", "n1", 30.0, None, None),
    # device b: one touch
    (4, "b", "ios", D(2024, 1, 1), "c1", "n1", 5.0, None, "Opt in"),
    # device c: two touches, one opt-out with a bucket, one with no campaign (dropped)
    (5, "c", "ios", D(2024, 1, 3), "c2", "n2", None, 4, "Opt out"),
    (6, "c", "ios", D(2024, 1, 1), "c1", "n2", 7.0, None, "Opt in"),
    (7, "c", "ios", D(2024, 1, 5), None, "n2", 9.0, None, "Opt in"),
]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _orders(df):
    return {r["src_id"]: (r["touchpoint_order"], r["touchpoint_count"]) for r in df.collect()}


def test_touchpoint_order_breaks_ties_by_source_id(users):
    o = _orders(attr.touchpoints(users))
    assert o == {1: (1, 3), 2: (2, 3), 3: (3, 3), 4: (1, 1), 6: (1, 2), 5: (2, 2)}


def test_blocks_of_any_size_give_the_same_order(users, spark):
    # with one id per block every row is a block of its own
    assert _orders(attr.touchpoints(users, block_ids=1)) == _orders(attr.touchpoints(users))


def test_rows_without_device_or_day_are_ranked(spark):
    rows = ROWS + [(8, None, "ios", None, "c1", "n1", 1.0, None, "Opt in"), (9, None, "ios", D(2024, 1, 1), "c1", "n1", 1.0, None, "Opt in"),
                   (10, None, "ios", None, "c1", "n1", 2.0, None, "Opt in"), (11, "a", "android", None, "c9", "n1", 1.0, None, None)]
    got = attr.touchpoints(spark.createDataFrame(rows, SCHEMA), block_ids=2)
    assert _orders(got) == {11: (1, 4), 1: (2, 4), 2: (3, 4), 3: (4, 4), 4: (1, 1), 6: (1, 2), 5: (2, 2), 8: (1, 3), 10: (2, 3), 9: (3, 3)}
    assert {r["src_id"]: r["device_revenue"] for r in got.where("adid IS NULL").collect()} == {8: 4.0, 9: 4.0, 10: 4.0}


def test_no_job_runs_while_the_plan_is_made(users, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "attribution")
    try:
        attr.attribution_all(attr.touchpoints(users), spark.createDataFrame([], "platform string, campaign_name string, network_name string, total_spend double"))
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_on_skewed_input(spark):
    # one device holds 70 % of the rows; ranks must equal the plain window ranks
    n = 5000
    df = (spark.range(n).select(
        F.col("id").alias("src_id"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("adid"),
        F.lit("ios").alias("platform"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 13).cast("int")).alias("install_date"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("campaign_name"),
        F.lit("n").alias("network_name"), F.lit(1.0).alias("revenue_usd"),
        F.lit(None).cast("int").alias("cv_bucket"), F.lit("Opt in").alias("tracking_status")))
    plain = df.withColumn("touchpoint_order", F.row_number().over(Window.partitionBy("adid").orderBy(*attr.TOUCH_ORDER)))
    plain = plain.withColumn("touchpoint_count", F.count("*").over(Window.partitionBy("adid")))
    assert _orders(attr.touchpoints(df, block_ids=64)) == _orders(plain)


def test_models_literal_and_normalized(users):
    tp = attr.touchpoints(users)
    revenue = {r["adid"]: r["rev"] for r in tp.groupBy("adid").agg(F.sum("adjusted_revenue").alias("rev")).collect()}
    total = sum(revenue.values())
    # normalized models hand out exactly the device revenue
    for fn in (attr.linear_norm, attr.time_decay_norm, attr.position_norm):
        out = fn(tp)
        col = [c for c in out.columns if c.endswith("_revenue")][0]
        assert out.agg(F.sum(col)).first()[0] == pytest.approx(total)
    # first touch: one row per device
    ft = attr.first_touch(tp)
    assert ft.agg(F.sum("first_touch_users")).first()[0] == 3
    # literal linear on device a: 10/1 + 30/2 + 20/3 (c1 gets 10, c2 gets 15 + 6.67)
    la = {(r["platform"], r["campaign_name"], r["network_name"]): r["linear_revenue"] for r in attr.linear(tp).collect()}
    assert la[("android", "c2", "n1")] == pytest.approx(30 / 2 + 20 / 3)
    # opt-out install credited with the bucket lower bound 4 * 0.05
    assert la[("ios", "c2", "n2")] == pytest.approx(0.2 / 2)


def test_attribution_all_equals_per_model_tables(users, spark):
    tp = attr.touchpoints(users)
    spend = spark.createDataFrame([("android", "c2", "n1", 100.0)],
                                  "platform string, campaign_name string, network_name string, total_spend double")
    allm = {(r["platform"], r["campaign_name"], r["network_name"]): r for r in attr.attribution_all(tp, spend).collect()}
    for fn, users_col, rev_col in ((attr.first_touch, "first_touch_users", "first_touch_revenue"),
                                   (attr.last_touch, "last_touch_users", "last_touch_revenue"),
                                   (attr.linear, "linear_users", "linear_revenue"),
                                   (attr.time_decay, "time_decay_users", "time_decay_revenue"),
                                   (attr.position, "position_users", "position_revenue")):
        for r in fn(tp).collect():
            k = (r["platform"], r["campaign_name"], r["network_name"])
            assert allm[k][users_col] == r[users_col]
            assert allm[k][rev_col] == pytest.approx(r[rev_col] or 0.0)
    a = allm[("android", "c2", "n1")]
    assert a["linear_roas"] == pytest.approx(a["linear_revenue"] / 100.0)
    assert allm[("ios", "c1", "n1")]["linear_roas"] == 0.0  # no spend row

