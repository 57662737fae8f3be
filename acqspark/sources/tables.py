"""Parquet scans of the given tables. Column pruning and filter pushdown are
left to Catalyst: callers select only what they use."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Known schemas of the input tables the models read. Declaring them skips
# Parquet schema inference (a footer-reading job per table on every plan);
# columns are matched by name, so only the ones a query uses are read.
KNOWN_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    path = f"{base.rstrip('/')}/{name}.parquet"
    schema = KNOWN_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


@dataclass
class TableSet:
    """Lazily opened tables under one directory (one Parquet file/dir per table)."""

    spark: SparkSession
    base: str
    _cache: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.base, name)
        return self._cache[name]
