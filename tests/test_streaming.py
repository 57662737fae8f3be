import datetime as dt

from pyspark.sql import functions as F

from acqspark.operators import staging
from acqspark.streaming import start_staging_stream

D = dt.date
SCHEMA = "date date, platform string, network_name string, campaign_name string, spend double"


def test_spend_stream_merges_batches_like_a_full_rebuild(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "stg_spend")
    first = spark.createDataFrame([(D(2024, 1, 1), "ios", "n", "c", 1.0), (D(2024, 1, 2), "ios", "n", "c", 2.0)],
                                  SCHEMA)
    first.write.mode("append").parquet(src)
    q = start_staging_stream(spark, "spend", src, table, checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    # second arrival: a duplicate line and a new day
    second = spark.createDataFrame([(D(2024, 1, 2), "ios", "n", "c", 2.0), (D(2024, 1, 3), "ios", "n", "c", 3.0)],
                                   SCHEMA)
    second.write.mode("append").parquet(src)
    q = start_staging_stream(spark, "spend", src, table, checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(table)
    want = staging.stg_spend(first.unionByName(second))  # equal lines are two lines
    assert sorted(got.select("spend_id").collect()) == sorted(want.select("spend_id").collect())
    assert got.agg(F.sum("spend")).first()[0] == 8.0


def test_install_stream_keeps_late_rows_and_takes_restatements(spark, tmp_path):
    from acqspark.plans.mart import Mart
    from conftest import SF_SMALL

    src, table = str(tmp_path / "in"), str(tmp_path / "stg_user_data")
    rows = Mart.from_tables(spark, SF_SMALL).user_data.orderBy("src_id").limit(3)
    first = spark.createDataFrame(rows.collect(), rows.schema)
    one = first.orderBy("src_id").limit(1)
    late = one.withColumn("src_id", F.lit(-1).cast("bigint")).withColumn("install_date", F.lit(D(2020, 1, 1)))
    campaign = one.withColumn("src_id", F.lit(-2).cast("bigint")).withColumn("campaign_name", F.lit("other"))
    restated = one.withColumn("revenue_usd", F.lit(99.0))
    for part in (first, late.unionByName(campaign).unionByName(restated)):
        part.coalesce(1).write.mode("append").parquet(src)
        start_staging_stream(spark, "user_data", src, table, schema=first.schema, checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r["src_id"]: r for r in spark.read.parquet(table).collect()}
    assert len(got) == 5 and got[-1]["install_date"] == D(2020, 1, 1) and got[-2]["campaign_name"] == "other"
    assert got[one.first()["src_id"]]["revenue_usd"] == 99.0


def test_refresh_daily_recomputes_only_touched_days(spark, tmp_path):
    from acqspark.plans.mart import Mart
    from acqspark.sources import sinks
    from acqspark.streaming import refresh_daily
    from conftest import SF_SMALL
    m = Mart.from_tables(spark, SF_SMALL, as_of=D(2024, 7, 28))
    path = str(tmp_path / "daily")
    # a stale table: the daily fact with one day's revenue zeroed out
    day = D(2024, 3, 1)
    stale = m.campaign_daily.withColumn(
        "daily_revenue", F.when(F.col("date") == day, F.lit(0.0)).otherwise(F.col("daily_revenue")))
    sinks.write_partitioned(stale, path)
    touched = spark.createDataFrame([(day,)], "date date")
    refresh_daily(spark, m.stg_spend, m.stg_user_data, m.dims, touched, path)
    got = spark.read.parquet(path).select("campaign_daily_id", "daily_revenue")
    want = m.campaign_daily.select("campaign_daily_id", "daily_revenue")
    assert sorted(got.collect()) == sorted(want.collect())


def _lines(spark, folder, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_two_sources_and_a_new_checkpoint_lose_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    run = lambda src, ck: start_staging_stream(spark, "spend", str(tmp_path / src), table, checkpoint=str(tmp_path / ck)).awaitTermination()
    _lines(spark, str(tmp_path / "a"), (D(2024, 1, 1), "ios", "n", "c", 1.0))
    _lines(spark, str(tmp_path / "b"), (D(2024, 1, 1), "ios", "n", "c", 2.0))
    run("a", "ck-a")
    run("b", "ck-b")  # its batch 0 isn't the batch 0 of the first
    run("a", "ck-a")  # nothing new
    total = lambda: spark.read.parquet(table).agg(F.sum("spend")).first()[0]
    assert total() == 3.0
    _lines(spark, str(tmp_path / "c"), (D(2024, 1, 2), "ios", "n", "c", 5.0))
    run("c", "ck-new")
    assert total() == 8.0


def test_a_batch_broken_off_half_way_is_completed(spark, tmp_path):
    from acqspark.sources import sinks
    from acqspark.streaming.ingest import append_batch, ledger_path

    table = str(tmp_path / "t")
    batch = staging.stg_spend(spark.createDataFrame([(D(2024, 1, 1), "ios", "n", "c", 1.0), (D(2024, 1, 2), "ios", "n", "c", 2.0)], SCHEMA))
    cluster = ("platform", "network_name", "campaign_name")
    # the first attempt got one day out and died before the ledger had the batch
    half = batch.where(F.col("date") == D(2024, 1, 1)).withColumn("batch", F.lit("s-0"))
    sinks.write_partitioned(half, table, "date", cluster, batch_col="batch")
    for _ in range(2):
        append_batch(spark, batch, "s", 0, table, "date", cluster)
    assert sorted(r["spend"] for r in spark.read.parquet(table).collect()) == [1.0, 2.0]
    ledger = spark.read.json(ledger_path(table)).collect()
    assert [(r["stream"], r["batch"], r["rows"], r["days"]) for r in ledger] == [("s", 0, 2, ["2024-01-01", "2024-01-02"])]


def test_a_restated_install_that_moves_day_stands_once(spark, tmp_path):
    from acqspark.plans.mart import Mart
    from conftest import SF_SMALL

    src, table = str(tmp_path / "in"), str(tmp_path / "stg")
    rows = Mart.from_tables(spark, SF_SMALL).user_data.orderBy("src_id").limit(3)
    first = spark.createDataFrame(rows.collect(), rows.schema)
    moved = first.orderBy("src_id").limit(1).withColumn("install_date", F.lit(D(2025, 1, 1)))
    for part in (first, moved):
        part.coalesce(1).write.mode("append").parquet(src)
        start_staging_stream(spark, "user_data", src, table, schema=first.schema, checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 3 and got.select("src_id").distinct().count() == 3
    assert got.where(F.col("install_date") == D(2025, 1, 1)).count() == 1
