"""Column-level helpers: surrogate keys, guarded ratios, revenue estimates, dates."""

from .keys import surrogate_key, money_key
from .metrics import safe_ratio, adjusted_revenue, as_col, round_cols, money_sum
from .dates import day_name, season_of, month_index, month_start

__all__ = [
    "surrogate_key", "money_key", "safe_ratio", "adjusted_revenue", "as_col",
    "round_cols", "money_sum", "day_name", "season_of", "month_index", "month_start",
]
