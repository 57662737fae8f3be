from pyspark.sql import functions as F

from acqspark.operators import quality


def test_scores_union_by_name_and_empty_table(spark):
    users = spark.createDataFrame([("u", "a", "ios", None, "Opt in"), ("v", "b", "web", None, "Maybe"),
                                   ("w", None, "android", None, None)],
                                  "user_id string, adid string, platform string, install_date date, "
                                  "tracking_status string")
    spend = spark.createDataFrame([], "spend_id string, date date, spend double, platform string")
    s = quality.dq_scores(quality.dq_users(users), quality.dq_spend(spend))
    rows = {r["check_type"]: r for r in s.collect()}
    u = rows["user_data_quality"]
    # 3 rows; 3 null install dates + 1 null adid + 1 bad platform + 1 bad status (NULL passes)
    assert (u["null_install_dates"], u["null_adids"], u["invalid_platforms"], u["invalid_tracking_status"]) == (3, 1, 1, 1)
    assert u["data_quality_score"] == round((1 - 6 / 3) * 100, 2)
    assert u["null_spend_ids"] is None  # not applicable to this check
    e = rows["spend_data_consistency"]
    assert e["total_records"] == 0 and e["data_quality_score"] is None and e["data_quality_status"] == "Poor"


def test_column_tests_and_report(spark):
    models = {name: None for name in quality.NOT_NULL}
    df = spark.createDataFrame([("a", "x"), ("a", None)], "user_id string, adid string")
    assert [r["n_records"] for r in quality.duplicate_keys(df, "user_id").collect()] == [2]
    v = quality.store_failures(quality.unique_violations(df, "user_id"), ["user_id", "adid"], limit=1)
    assert v.count() == 1
    col = spark.createDataFrame([("not_null", "m", "c", 0), ("unique", "m", "k", 2)],
                                "test_type string, model string, column_name string, failures bigint")
    one = spark.createDataFrame([(0,)], "x int")
    checks = {name: one.select(*[F.lit(1 if name == "dq_referential" else 0).alias(c) for c in bad] or [F.lit(0)])
              for _, _, name, bad in quality.AGGREGATE_TESTS}
    rep = {r["test_name"]: r for r in quality.test_report(col, checks).collect()}
    assert rep["not_null_m_c"]["status"] == "pass"
    assert rep["unique_m_k"]["status"] == "warn"
    assert rep["test_referential_integrity"]["failures"] == 3
    assert rep["test_referential_integrity"]["status"] == "fail"
    assert models  # the spec names the models it tests


def test_all_declared_tests_are_registered():
    counts = (sum(map(len, quality.NOT_NULL.values())), len(quality.ACCEPTED), len(quality.RELATIONSHIPS), len(quality.UNIQUE))
    assert counts == (137, 22, 23, 14) and sum(counts) == 196


def test_relationships_and_keys_are_counted_by_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "RELATIONSHIPS", [("child", "x", "parent", "y"), ("child", "z", "parent", "y")])
    monkeypatch.setattr(quality, "UNIQUE", {"child": "x", "parent": "y"})
    models = {"child": spark.createDataFrame([(1, 7), (1, 2), (3, None), (None, 2), (None, 2)], "x int, z int"),
              "parent": spark.createDataFrame([(2,), (3,)], "y int")}
    got = {(r["model"], r["column_name"]): r["failures"] for r in quality.test_relationships(models).collect()}
    assert got == {("child", "x"): 2, ("child", "z"): 1}
    got = {(r["model"], r["column_name"]): r["failures"] for r in quality.test_unique(models).collect()}
    assert got == {("child", "x"): 2, ("parent", "y"): 0}  # 1 and NULL
