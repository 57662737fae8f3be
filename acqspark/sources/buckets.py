"""The conversion-value bucket table (64 rows, generated by rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 64 buckets (0-63), bucket b covers [0.05*b, 0.05*(b+1)) USD.
N_BUCKETS = 64


def cv_bucket_table(spark: SparkSession) -> DataFrame:
    """Bounds computed in decimal then cast, so they equal the CSV text values
    (0.15, not 0.15000000000000002). Its size is fixed at 64 rows, which is
    what makes broadcasting it safe at any data size."""
    b = F.col("id")
    return spark.range(N_BUCKETS).select(
        b.cast("int").alias("cv_bucket"),
        F.expr("cast(id * 0.05 as double)").alias("rev_min"),
        F.expr("cast((id + 1) * 0.05 as double)").alias("rev_max"),
    )


def with_midpoint(buckets: DataFrame) -> DataFrame:
    return buckets.select("cv_bucket", ((F.col("rev_min") + F.col("rev_max")) / 2).alias("revenue_est_bucket"))
