"""The retention triangle on devices that install often, again, or without an id."""

from datetime import date

from acqspark.operators.cohorts import cohort_retention

SCHEMA = "adid string, platform string, install_date date, tracking_status string, cv_bucket int, revenue_usd double"


def test_hot_device_several_platforms_and_null_ids(spark):
    rows = [("hot", "Android", date(2024, 1, 1 + i % 28), "Opt in", None, 1.0) for i in range(700)]
    rows += [("hot", "Android", date(2024, 3, 5), "Opt in", None, 2.0), ("hot", "iOS", date(2024, 2, 1), "Opt in", None, 3.0),
             ("b", "Android", date(2024, 1, 9), "Opt in", None, 4.0), ("b", "Android", None, "Opt in", None, 0.5),
             (None, "Android", date(2024, 1, 2), "Opt in", None, 9.0), ("c", "iOS", None, "Opt in", None, 9.0)]
    got = {(r.platform, r.cohort_month.month, r.months_since_install): (r.active_users, r.cohort_size, r.cohort_revenue)
           for r in cohort_retention(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("Android", 1, 0): (2, 2, 704.0), ("Android", 1, 2): (1, 2, 2.0),
                   ("Android", 1, None): (1, 2, 0.5), ("iOS", 1, 1): (1, 1, 3.0)}


def test_no_installs(spark):
    assert cohort_retention(spark.createDataFrame([], SCHEMA)).count() == 0
