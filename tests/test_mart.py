"""Materialization paths of the mart: warehouse build, materialized mode,
temporary views, CSV export."""

import pytest
from pyspark.sql import functions as F

from acqspark.plans.mart import Mart
from acqspark.sources import sinks

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def mart(spark):
    return Mart.from_tables(spark, SF_SMALL)


def _rows(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_materialized_mode_equals_lazy(mart):
    mat = mart.materialized()
    for name, cols in (("perf_fact", ["campaign_id", "network_id", "platform_id", "total_users", "roas"]),
                       ("campaign_summary", ["summary_id", "last_30d_users", "avg_30d_roas", "campaign_health_score"]),
                       ("daily_enriched", ["date", "platform", "campaign_name", "daily_users", "daily_roas"])):
        assert _rows(getattr(mart, name), cols) == _rows(getattr(mat, name), cols)


def test_build_writes_every_model_with_audit_columns(mart, spark, tmp_path):
    out = mart.build(str(tmp_path / "mart"))
    assert set(out) == set(mart.models)
    from acqspark.operators import lineage
    assert set(lineage.MODEL_INPUTS) == set(mart.models)  # an edge for every model that a model reads
    facts = {r["model_name"]: r for r in spark.read.parquet(out["governance_data_lineage"]).collect()}
    assert facts["fact_campaign_daily"]["row_count"] == mart.campaign_daily.count()
    assert facts["stg_spend"]["last_updated"] is not None and str(facts["stg_spend"]["last_updated"])[:10] != lineage.LAST_UPDATED
    edges = {tuple(r) for r in spark.read.parquet(str(tmp_path / "mart" / "governance_lineage_edges")).collect()}
    assert ("fact_campaign_summary", "fact_campaign_daily") in edges
    daily = spark.read.parquet(out["fact_campaign_daily"])
    assert daily.count() == mart.campaign_daily.count()
    assert {"created_at", "updated_at"} <= set(daily.columns)
    ts = daily.select("created_at").distinct().collect()
    assert len(ts) == 1 and str(ts[0][0]).startswith("2024-09-26")
    plan = daily.filter(F.col("date") == F.lit("2024-07-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_views_and_csv_export(mart, spark, tmp_path):
    names = mart.register_views(prefix="t_")
    assert "t_fact_campaign_daily" in names
    n = spark.sql("select count(*) from t_fact_campaign_daily").first()[0]
    assert n == mart.campaign_daily.count()
    path = str(tmp_path / "kpi_csv")
    sinks.export_csv(mart.campaign_metrics, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == mart.campaign_metrics.count()
    assert back.columns == mart.campaign_metrics.columns


def test_summary_growth_between_snapshots(mart, spark, tmp_path):
    import datetime as dt

    out = str(tmp_path / "m")
    day = dt.date(2024, 6, 30)
    first = Mart(spark, mart.user_data.where(F.col("install_date") <= day), mart.spend.where(F.col("date") <= day), as_of=day)
    names = ("fact_campaign_summary", "governance_data_quality")
    path = first.build(out, only=names)["fact_campaign_summary"]
    for _ in range(2):  # a repeated run replaces its own snapshot and compares with the same earlier one
        mart.build(out, only=names)
    rows = spark.read.parquet(path)
    assert rows.select("as_of").distinct().count() == 2
    cells = {}
    for r in rows.collect():
        cells.setdefault(r["summary_id"], {})[str(r["as_of"])] = r
    grown = 0
    for by_day in cells.values():
        late = by_day[max(by_day)]
        if len(by_day) == 2 and by_day[min(by_day)]["total_revenue"] > 0:
            before = by_day[min(by_day)]["total_revenue"]
            assert late["revenue_growth_rate"] == pytest.approx((late["total_revenue"] - before) / before)
            grown += late["revenue_growth_rate"] != 0
        elif str(late["as_of"]) != "2024-06-30":
            assert late["revenue_growth_rate"] == 0
    assert grown > 5
    scores = spark.read.parquet(out + "/governance_data_quality")
    from acqspark.operators import quality
    ordered = [r["created_at"] for r in quality.history(scores).collect()]
    assert len(ordered) == 8 and ordered == sorted(ordered, reverse=True)


def test_full_build_on_fewer_days_leaves_none_behind_and_incremental_keeps_them(mart, spark, tmp_path):
    out = str(tmp_path / "m")
    names = ("fact_campaign_daily",)
    path = mart.build(out, only=names)["fact_campaign_daily"]
    whole = spark.read.parquet(path).select("campaign_daily_id", "daily_revenue").collect()
    late = Mart(spark, mart.user_data, mart.spend.where(F.col("date") <= mart.as_of))
    late.build(out, incremental=True, only=names)  # the last days again, merged
    assert sorted(spark.read.parquet(path).select("campaign_daily_id", "daily_revenue").collect()) == sorted(whole)
    import datetime as dt
    few = Mart(spark, mart.user_data.where(F.col("install_date") < dt.date(2024, 3, 1)), mart.spend.where(F.col("date") < dt.date(2024, 3, 1)))
    few.build(out, only=names)
    assert spark.read.parquet(path).agg(F.max("date")).first()[0] < dt.date(2024, 3, 1)


def test_names_with_spend_but_no_install_stay_in_the_daily_fact(mart, spark):
    extra = mart.spend.limit(1).withColumns({"campaign_name": F.lit("campaign_new"), "spend": F.lit(5.0), "src_id": F.lit(-1).cast("bigint")})
    m = Mart(spark, mart.user_data, mart.spend.unionByName(extra))
    new = m.daily_enriched.where(F.col("campaign_name") == "campaign_new").collect()
    assert [r["daily_spend"] for r in new] == [5.0]
    assert new[0]["daily_users"] == 0 and m.materialized().daily_enriched.where(F.col("campaign_name") == "campaign_new").count() == 1


def test_classifier_feeds_the_mart_and_repeats(mart, spark, tmp_path):
    path = str(tmp_path / "forest")
    lone = mart.user_data.limit(1).withColumn("campaign_name", F.lit("campaign_unpaid"))
    users = mart.user_data.unionByName(lone)
    keys = ["platform", "campaign_name", "network_name"]
    runs = [Mart(spark, users.repartition(n), mart.spend, probability="model", model_path=p) for n, p in ((3, None), (5, path), (2, path))]
    got = [sorted(tuple(r) for r in m.classifier.select(*keys, "high_roas_prob", "prob_basis").collect()) for m in runs]
    assert got[0] == got[1] == got[2]
    assert {r[4] for r in got[0] if r[1] == "campaign_unpaid"} == {"no spend or users"}
    fact = {tuple(r) for r in runs[1].perf_named.select(*keys, "high_roas_prob").collect()}
    assert fact == {r[:4] for r in got[0]} and len({p for *_, p in fact}) > 2


def test_failures_of_all_runs_are_stored(mart, spark, tmp_path):
    import json

    out = str(tmp_path / "m")
    path = mart.store_failures(out, "run-1")
    mart.store_failures(out, "run-2", limit=3)
    stored = spark.read.parquet(path)
    report = {r["test_name"]: r["failures"] for r in mart.test_report.collect()}
    counts = {(r["run"], r["test_name"]): r["n"] for r in stored.groupBy("run", "test_name").agg(F.count("*").alias("n")).collect()}
    failing = {t for t, n in report.items() if n and not t.startswith("test_")}
    assert {t for run, t in counts if run == "run-1"} == failing and failing
    for t in failing:
        if not t.startswith("unique_"):
            assert counts["run-1", t] == report[t]
        assert counts["run-2", t] == min(3, counts["run-1", t])
    assert json.loads(stored.first()["row"])
