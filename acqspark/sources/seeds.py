"""CSV intake with explicit schemas (never inferSchema): good rows go to a table,
bad lines to a quarantine table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEND_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("network_name", T.StringType(), False),
    T.StructField("campaign_name", T.StringType(), False),
    T.StructField("spend", T.DoubleType(), False),
])

USER_DATA_SCHEMA = T.StructType([
    T.StructField("adid", T.StringType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("install_date", T.DateType(), False),
    T.StructField("campaign_name", T.StringType(), True),
    T.StructField("network_name", T.StringType(), True),
    T.StructField("revenue_usd", T.DoubleType(), True),
    T.StructField("cv_bucket", T.IntegerType(), True),
    T.StructField("tracking_status", T.StringType(), True),
])

CV_BUCKET_SCHEMA = T.StructType([
    T.StructField("cv_bucket", T.IntegerType(), False),
    T.StructField("rev_min", T.DoubleType(), False),
    T.StructField("rev_max", T.DoubleType(), False),
])

CAMPAIGN_ANALYSIS_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType(), False),
    T.StructField("campaign_name", T.StringType(), False),
    T.StructField("network_name", T.StringType(), False),
    T.StructField("total_revenue", T.DoubleType(), True),
    T.StructField("total_users", T.LongType(), True),
    T.StructField("total_spend", T.DoubleType(), True),
    T.StructField("conversion_rate", T.IntegerType(), True),
    T.StructField("roas", T.DoubleType(), True),
    T.StructField("arpu", T.DoubleType(), True),
    T.StructField("forecasted_revenue", T.DoubleType(), True),
    T.StructField("high_roas", T.IntegerType(), True),
    T.StructField("high_roas_prob", T.DoubleType(), True),
])


#: The declared CSV files and their columns.
SEEDS = {"spend": SPEND_SCHEMA, "user_data": USER_DATA_SCHEMA, "dim_cv_bucket": CV_BUCKET_SCHEMA,
         "campaign_analysis": CAMPAIGN_ANALYSIS_SCHEMA}
_LINE = "_line"
BAD_ROWS = "kind string, file string, reason string, line string"


def read_csv(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of a declared file (or folder of files), and the lines that
    can't be loaded with the reason: a line that doesn't fit the columns or
    their types, or lacks a required value. A file whose header names other
    columns is an error, as all of its rows would be wrong."""
    schema = SEEDS[kind]
    loose = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField(_LINE, T.StringType(), True)])
    rows = (spark.read.schema(loose).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _LINE).option("dateFormat", "yyyy-MM-dd").csv(path))
    missing = F.concat_ws(", ", *[F.when(F.col(f.name).isNull(), f.name) for f in schema if not f.nullable])
    reason = F.when(F.col(_LINE).isNotNull(), "malformed line").when(missing != "", F.concat(F.lit("no "), missing))
    rows = rows.withColumns({"_reason": reason, "_file": F.col("_metadata.file_path")})
    bad = rows.where("_reason IS NOT NULL").select(
        F.lit(kind).alias("kind"), F.col("_file").alias("file"), F.col("_reason").alias("reason"),
        F.coalesce(F.col(_LINE), F.to_json(F.struct(*schema.names))).alias("line"))
    return rows.where("_reason IS NULL").select(*schema.names), bad


def load_csv(spark: SparkSession, kind: str, path: str, table: str, quarantine: str) -> DataFrame:
    """Loads a declared file into the Parquet table ``table``; lines that can't
    be loaded are added to the table ``quarantine``. Every loaded row gets a
    ``src_id``, fixed by being written."""
    good, bad = read_csv(spark, kind, path)
    bad.write.mode("append").partitionBy("kind").parquet(quarantine)
    good.withColumn("src_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)
