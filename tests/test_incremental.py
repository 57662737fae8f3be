import datetime as dt

from pyspark.sql import functions as F

from acqspark.operators import staging
from acqspark.sources import sinks

D = dt.date
SCHEMA = "src_id bigint, date date, platform string, network_name string, campaign_name string, spend double"


def _spend(spark):
    return spark.createDataFrame([
        (1, D(2024, 1, 1), "ios", "n", "c", 1.0),
        (2, D(2024, 1, 1), "ios", "n", "c", 1.0),   # same key as 1: dedupe keeps src 2
        (3, D(2024, 1, 2), "ios", "n", "c", 2.0),
        (4, D(2024, 1, 3), "ios", "n", "c", 3.0),
    ], SCHEMA)


def test_dedupe_keeps_highest_source(spark):
    out = staging.dedupe_latest(staging.stg_spend(_spend(spark)), "spend_id")
    assert sorted(r["src_id"] for r in out.collect()) == [2, 3, 4]


def test_incremental_equals_full_rebuild_for_on_time_data(spark):
    sp = _spend(spark)
    inc = staging.incremental_stg_spend(sp, D(2024, 1, 1))
    full = staging.stg_spend(sp)  # two lines with one key are both kept
    assert inc.count() == 4
    assert sorted(inc.collect()) == sorted(full.select(*inc.columns).collect())


def test_empty_target_loads_everything(spark):
    sp = staging.stg_spend(_spend(spark))
    empty = sp.filter(F.lit(False))
    assert staging.after_high_water(sp, empty, "date").count() == 4
    assert staging.after_high_water(sp, sp.filter(F.col("date") <= D(2024, 1, 2)), "date").count() == 1


def test_upsert_twice_is_once(spark):
    t = staging.dedupe_latest(staging.stg_spend(_spend(spark)), "spend_id")
    src = t.filter(F.col("src_id") == 4).withColumn("spend", F.lit(3.0))
    once = staging.upsert(t, src, "spend_id")
    twice = staging.upsert(once, src, "spend_id")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == 3


def test_partitioned_merge_roundtrip(spark, tmp_path):
    path = str(tmp_path / "daily")
    base = spark.createDataFrame([("k1", D(2024, 1, 1), 1.0, "p", "n", "c"), ("k2", D(2024, 1, 2), 2.0, "p", "n", "c")],
                                 "campaign_daily_id string, date date, v double, platform_id string, "
                                 "network_id string, campaign_id string")
    sinks.write_partitioned(base, path)
    src = spark.createDataFrame([("k2", D(2024, 1, 2), 20.0, "p", "n", "c"), ("k3", D(2024, 1, 3), 3.0, "p", "n", "c")],
                                base.schema)
    sinks.merge_into_partitioned(spark, path, src, "campaign_daily_id")
    got = {r["campaign_daily_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {"k1": 1.0, "k2": 20.0, "k3": 3.0}
    # partition pruning on the stored table
    plan = spark.read.parquet(path).filter(F.col("date") == D(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_merge_raises_on_an_unreadable_table_and_leaves_it(spark, tmp_path):
    import pytest

    path = tmp_path / "daily"
    schema = "campaign_daily_id string, date date, v double, platform_id string, network_id string, campaign_id string"
    sinks.write_partitioned(spark.createDataFrame([("k1", D(2024, 1, 1), 1.0, "p", "n", "c")], schema), str(path))
    part = next(path.glob("date=*/*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-8])
    with pytest.raises(Exception):
        sinks.merge_into_partitioned(spark, str(path), spark.createDataFrame([("k3", D(2024, 1, 1), 3.0, "p", "n", "c")], schema), "campaign_daily_id")
    assert [p.name for p in path.glob("date=*/*.parquet")] == [part.name]


def test_calendar_reaches_back_to_the_first_input_day(spark):
    from acqspark.plans.mart import Mart
    from conftest import SF_SMALL

    m = Mart.from_tables(spark, SF_SMALL)
    old = m.spend.limit(1).withColumn("date", F.lit(D(2023, 5, 1)))
    m = Mart(spark, m.user_data, m.spend.unionByName(old))
    assert m.dim_date.agg(F.min("date")).first()[0] == D(2023, 5, 1)


def test_merge_of_a_row_that_changes_day(spark, tmp_path):
    schema = "src_id bigint, date date, v double, platform_id string, network_id string, campaign_id string"
    path = str(tmp_path / "t")
    row = lambda i, d, v: (i, d, v, "p", "n", "c")
    merge = lambda rows: sinks.merge_into_partitioned(spark, path, spark.createDataFrame(rows, schema), "src_id")
    merge([row(0, D(2024, 1, 31), 1.0), row(1, D(2024, 1, 31), 2.0), row(2, D(2024, 2, 1), 3.0)])
    untouched = sorted(p.name for p in (tmp_path / "t" / "date=2024-01-31").iterdir())
    merge([row(2, D(2024, 2, 2), 4.0)])  # leaves its old day empty
    assert not (tmp_path / "t" / "date=2024-02-01").exists()
    assert sorted(p.name for p in (tmp_path / "t" / "date=2024-01-31").iterdir()) == untouched  # that day isn't rewritten
    merge([row(0, D(2025, 1, 1), 9.0)])
    merge([row(0, D(2025, 1, 1), 9.0)])  # again
    got = lambda: sorted((r["src_id"], r["date"], r["v"]) for r in spark.read.parquet(path).collect())
    want = [(0, D(2025, 1, 1), 9.0), (1, D(2024, 1, 31), 2.0), (2, D(2024, 2, 2), 4.0)]
    assert got() == want
    sinks.compact_locator(spark, path, "src_id")
    merge([row(0, D(2024, 1, 31), 1.0)])
    assert got() == [(0, D(2024, 1, 31), 1.0), *want[1:]]
