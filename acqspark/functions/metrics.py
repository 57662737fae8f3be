"""Guarded ratios and the opt-out revenue estimates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conversion-value bucket width in USD, and the labels that mark
# an iOS install whose revenue is unknown (tracking opt-out).
CV_BUCKET_WIDTH = 0.05
IOS = "ios"
OPT_OUT = "Opt out"


def as_col(x) -> Column:
    """Accept a Column, a column name, or a Python literal (dates included)."""
    if isinstance(x, Column):
        return x
    if isinstance(x, (_dt.date, _dt.datetime, int, float, bool)) or x is None:
        return F.lit(x)
    return F.col(x)


def as_date(x) -> Column:
    """An ``as_of``-style date: a Column as is, a 'YYYY-MM-DD' string or a
    Python date as a DATE literal."""
    if isinstance(x, Column):
        return x
    return F.lit(x).cast("date")


def safe_ratio(num, den, otherwise=0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``otherwise`` (ANSI mode raises on /0)."""
    n, d = as_col(num), as_col(den)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(d > 0, n / d).otherwise(o)


def is_opt_out(platform="platform", tracking_status="tracking_status") -> Column:
    return (as_col(platform) == IOS) & (as_col(tracking_status) == OPT_OUT)


def adjusted_revenue(mode: str = "lower", null_as_zero: bool = True,
                     platform="platform", tracking_status="tracking_status",
                     cv_bucket="cv_bucket", revenue_usd="revenue_usd",
                     midpoint=None) -> Column:
    """Revenue per install with the opt-out estimate.

    mode="lower":    opt-out -> cv_bucket * 0.05 (lower bucket bound); the daily
                     fact turns a NULL bucket into 0 (``null_as_zero=True``),
                     attribution and cohorts keep it NULL (``False``).
    mode="midpoint": opt-out -> the bucket midpoint column ``midpoint`` (from a
                     join to the bucket table); everything NULL becomes 0.
    Everyone else -> coalesce(revenue_usd, 0).
    """
    other = F.coalesce(as_col(revenue_usd), F.lit(0.0))
    if mode == "lower":
        est = as_col(cv_bucket).cast("double") * F.lit(CV_BUCKET_WIDTH)
        if null_as_zero:
            est = F.coalesce(est, F.lit(0.0))
        return F.when(is_opt_out(platform, tracking_status), est).otherwise(other)
    if mode == "midpoint":
        if midpoint is None:
            raise ValueError("midpoint mode needs the bucket midpoint column")
        est = F.when(is_opt_out(platform, tracking_status), as_col(midpoint)).otherwise(as_col(revenue_usd))
        return F.coalesce(est, F.lit(0.0))
    raise ValueError(f"unknown mode {mode!r}")


# Decimals that money sums carry (far below a cent): a decimal sum doesn't
# depend on the order in which rows are added, a float sum does.
MONEY_DIGITS = 6


def money_sum(c) -> Column:
    return F.sum(as_col(c).cast(f"decimal(28,{MONEY_DIGITS})")).cast("double")


def round_cols(df: DataFrame, money=(), ratio=(), money_digits=4, ratio_digits=6) -> DataFrame:
    """Round float outputs for cross-engine comparison: float sums depend on
    summation order, so two engines agree only up to the last bits."""
    cols = {c: F.round(c, money_digits) for c in money}
    cols.update({c: F.round(c, ratio_digits) for c in ratio})
    return df.withColumns(cols) if cols else df
