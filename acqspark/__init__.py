"""acqspark: user-acquisition analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame. Nothing
is collected; Catalyst plans each result. Dates that the source models took
from the wall clock (``current_date()``, ``now()``) are an explicit ``as_of``
argument, which may be a Python date or a Column (for instance a scalar
subquery over the spend table, as the registered queries use).
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
