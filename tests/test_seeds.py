"""CSV intake of the four declared files, with broken lines, a wrong header and a wrong date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acqspark.plans.mart import Mart
from acqspark.sources import seeds

FILES = {
    "spend": ["date,platform,network_name,campaign_name,spend", "2024-01-01,ios,n1,c1,12.5", "2024-01-02,android,n1,\"c, 2\",3", "2024-13-40,ios,n1,c1,1",
              "2024-01-03,ios,n1,c1,notanumber", "2024-01-03,ios,n1,c1", "2024-01-03,ios,n1,c1,", "2024-01-04,ios,n2,c1,7"],
    "user_data": ["adid,platform,install_date,campaign_name,network_name,revenue_usd,cv_bucket,tracking_status", "a,ios,2024-01-01,c1,n1,,4,Opt out",
                  "b,ios,2024-01-02,c1,n1,2.5,,Opt in", ",ios,2024-01-02,c1,n1,2.5,,Opt in", "c,android,yesterday,c1,n1,1,,", "d,android,2024-01-03,,,1,,"],
    "dim_cv_bucket": ["cv_bucket,rev_min,rev_max", *[f"{i},{i * 0.05},{(i + 1) * 0.05}" for i in range(64)], "x,1,2"],
    "campaign_analysis": ["platform,campaign_name,network_name,total_revenue,total_users,total_spend,conversion_rate,roas,arpu,forecasted_revenue,high_roas,high_roas_prob",
                          "ios,c1,n1,10.5,3,2.5,100,4.2,3.5,1.25,1,0.9", "ios,c1"],
}
BAD = {"spend": 4, "user_data": 2, "dim_cv_bucket": 1, "campaign_analysis": 1}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("seeds")
    for kind, lines in FILES.items():
        (at / f"{kind}.csv").write_text("\n".join(lines) + "\n")
    return at


@pytest.mark.parametrize("kind", list(FILES))
def test_good_rows_are_loaded_and_bad_lines_kept_apart(spark, folder, tmp_path, kind):
    table = seeds.load_csv(spark, kind, str(folder / f"{kind}.csv"), str(tmp_path / "t"), str(tmp_path / "bad"))
    assert table.columns == [*seeds.SEEDS[kind].names, "src_id"]
    assert table.count() == len(FILES[kind]) - 1 - BAD[kind]
    assert table.select("src_id").distinct().count() == table.count()
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert len(bad) == BAD[kind] and all(r["kind"] == kind and r["file"].endswith(f"{kind}.csv") and r["reason"] and r["line"] for r in bad)


def test_reasons(spark, folder):
    _, bad = seeds.read_csv(spark, "spend", str(folder / "spend.csv"))
    reasons = sorted((r["reason"], r["line"]) for r in bad.collect())
    assert [r for r, _ in reasons] == ["malformed line"] * 3 + ["no spend"]
    assert "2024-13-40,ios,n1,c1,1" in [line for _, line in reasons]


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "spend.csv").write_text("day,platform,network_name,campaign_name,spend\n2024-01-01,ios,n,c,1\n")
    good, _ = seeds.read_csv(spark, "spend", str(tmp_path / "spend.csv"))
    with pytest.raises(Exception, match="header"):
        good.collect()


def test_a_mart_from_csv_files(spark, folder, tmp_path):
    m = Mart.from_csv(spark, str(folder), str(tmp_path))
    assert m.as_of == dt.date(2024, 1, 4)
    assert m.campaign_daily.agg(F.sum("daily_spend")).first()[0] == pytest.approx(22.5)
    assert {r["src_id"] for r in m.touchpoints.collect()} <= {r["src_id"] for r in m.user_data.collect()}
    assert spark.read.parquet(str(tmp_path / "quarantine")).groupBy("kind").count().count() == 3
