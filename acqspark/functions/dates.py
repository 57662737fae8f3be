"""Calendar helpers that behave the same in Spark and in ANSI SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import as_col

# Weekend day names and the season of each month
# (seasons start one month early: Nov-Jan is Winter).
WEEKEND = ("Saturday", "Sunday")
SEASON_MONTHS = {
    "Winter": (11, 12, 1),
    "Spring": (2, 3, 4),
    "Summer": (5, 6, 7),
    "Fall": (8, 9, 10),
}


def day_name(d) -> Column:
    """Full English day name. Spark's ``dayname`` gives 'Sat'; the models
    compare with 'Saturday', so format with EEEE."""
    return F.date_format(as_col(d), "EEEE")


def season_of(month) -> Column:
    m = as_col(month)
    out = None
    for name, months in SEASON_MONTHS.items():
        out = (F.when(m.isin(*months), F.lit(name)) if out is None
               else out.when(m.isin(*months), F.lit(name)))
    return out


def month_start(d) -> Column:
    """First day of the month, staying a DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(as_col(d), "MM")


def month_index(d) -> Column:
    """year*12 + month: month differences count calendar boundaries."""
    c = as_col(d)
    return F.year(c) * 12 + F.month(c)
