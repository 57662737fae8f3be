import datetime as dt
import hashlib

from pyspark.sql import functions as F

from acqspark.functions import surrogate_key, money_key, safe_ratio, adjusted_revenue, day_name, season_of, month_index
from acqspark.functions.keys import NULL_TOKEN


def test_surrogate_key_matches_md5_of_joined_strings(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 2), None)], "x string, d date, n string")
    got = df.select(surrogate_key("x", "d", "n").alias("k")).first()["k"]
    assert got == hashlib.md5(f"a-2024-01-02-{NULL_TOKEN}".encode()).hexdigest()


def test_money_key_is_fixed_scale(spark):
    df = spark.createDataFrame([(10000000.0,), (12.34,)], "v double")
    got = [r[0] for r in df.select(money_key("v").cast("string")).collect()]
    assert got == ["10000000.0000", "12.3400"]


def test_safe_ratio_guards_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_ratio("n", "d")).collect()]
    assert got == [0.0, 0.0, 1.5]


def test_adjusted_revenue_modes(spark):
    rows = [("ios", "Opt out", 3, None, 0.175), ("ios", "Opt out", None, None, None),
            ("android", None, None, 2.5, None), ("ios", "Opt in", None, None, None)]
    df = spark.createDataFrame(rows, "platform string, tracking_status string, cv_bucket int, "
                                     "revenue_usd double, mid double")
    out = df.select(adjusted_revenue("lower", True).alias("a"), adjusted_revenue("lower", False).alias("b"),
                    adjusted_revenue("midpoint", midpoint="mid").alias("c")).collect()
    assert [round(r["a"], 10) for r in out] == [0.15, 0.0, 2.5, 0.0]
    assert out[1]["b"] is None and round(out[0]["b"], 10) == 0.15
    assert [r["c"] for r in out] == [0.175, 0.0, 2.5, 0.0]


def test_calendar_helpers(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 2),), (dt.date(2024, 11, 1),)], "d date")
    out = df.select(day_name("d").alias("n"), season_of(F.month("d")).alias("s"),
                    month_index("d").alias("m")).collect()
    assert [r["n"] for r in out] == ["Saturday", "Friday"]
    assert [r["s"] for r in out] == ["Spring", "Winter"]
    assert out[1]["m"] - out[0]["m"] == 8
