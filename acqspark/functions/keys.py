"""Hash surrogate keys.

The key is md5 over the inputs cast to string, NULL replaced by a fixed
token, joined by '-'. It is computed row by row with no shuffle and no
ordering (unlike a ``row_number()`` key), so it is stable across runs and
partitionings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the public surrogate-key definition.
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
SEPARATOR = "-"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money_key(c) -> Column:
    """Doubles print differently across engines (1.0E7 vs 10000000.0); key
    money columns through a fixed-scale decimal instead."""
    return _c(c).cast("decimal(18,4)")


def surrogate_key(*cols) -> Column:
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_TOKEN)) for c in cols]
    return F.md5(F.concat_ws(SEPARATOR, *parts))
