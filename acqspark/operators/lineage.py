"""Lineage registry joined with live table statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import surrogate_key

# The model registry (source table, model, layer, description).
REGISTRY = [
    ("spend", "stg_spend", "Staging", "Raw spend data from advertising platforms"),
    ("user_data", "stg_user_data", "Staging", "Raw user acquisition data"),
    ("dim_cv_bucket", "stg_dim_cv_bucket", "Staging", "Conversion value bucket mapping"),
    ("campaign_analysis", "stg_campaign_metrics", "Staging", "Campaign metrics from ML analysis"),
    (None, "dim_campaign", "Mart", "Campaign dimension table"),
    (None, "dim_network", "Mart", "Network dimension table"),
    (None, "dim_platform", "Mart", "Platform dimension table"),
    (None, "dim_date", "Mart", "Date dimension table"),
    (None, "dim_campaign_performance_tier", "Mart", "Campaign performance tier classification"),
    (None, "fact_campaign_performance", "Mart", "Campaign performance fact table"),
    (None, "fact_campaign_daily", "Mart", "Daily campaign performance metrics"),
    (None, "fact_campaign_summary", "Mart", "Campaign performance summary"),
    (None, "governance_data_quality", "Governance", "Data quality monitoring"),
    (None, "governance_data_lineage", "Governance", "Data lineage documentation"),
]
# The tables whose row counts the lineage reports, and the
# placeholder refresh date it prints.
STATS_TABLES = ("fact_campaign_performance", "fact_campaign_daily", "stg_spend", "stg_user_data")
LAST_UPDATED = "2024-01-01"
LAYER_OWNER = {"Staging": "Data Engineering", "Mart": "Analytics Engineering", "Governance": "Data Governance"}
LAYER_RETENTION = {"Staging": "90 days", "Mart": "3 years", "Governance": "1 year"}

REGISTRY_SCHEMA = T.StructType([
    T.StructField("source_table", T.StringType(), True),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("layer", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
])


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (count(*) prunes every column it can)."""
    parts = [tables[name].agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(LAST_UPDATED).alias("last_updated"))
        for name in STATS_TABLES]
    return reduce(DataFrame.unionByName, parts)


def _by_layer(mapping, default):
    layer = F.col("layer")
    out = None
    for k, v in mapping.items():
        out = F.when(layer == k, v) if out is None else out.when(layer == k, v)
    return out.otherwise(default)


def lineage(spark: SparkSession, stats: DataFrame) -> DataFrame:
    r = registry(spark)
    j = r.join(stats, r["model_name"] == stats["table_name"], "left")
    m = F.col("model_name")
    classification = (F.when(m.like("%user%") | m.like("%spend%"), "PII/Financial")
                      .when(m.like("%campaign%"), "Business Critical").otherwise("Standard"))
    refresh = _by_layer({k: "Daily" for k in LAYER_OWNER}, "N/A")
    return j.select(surrogate_key("model_name").alias("lineage_id"), "source_table", "model_name", "layer",
                    "description", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
                    "last_updated", _by_layer(LAYER_OWNER, "Unknown").alias("data_owner"),
                    classification.alias("data_classification"),
                    _by_layer(LAYER_RETENTION, "N/A").alias("retention_policy"),
                    refresh.alias("refresh_frequency"))


# What each model is made of.
_DIMS = ("dim_campaign", "dim_network", "dim_platform")
MODEL_INPUTS = {
    "stg_spend": ("spend",), "stg_user_data": ("user_data",), "dim_cv_bucket": (),
    "stg_campaign_metrics": ("stg_user_data", "stg_spend", "dim_cv_bucket"),
    **{d: ("stg_user_data", "stg_spend") for d in _DIMS},
    "dim_date": ("user_data", "spend"),
    "fact_campaign_daily": ("stg_spend", "stg_user_data", *_DIMS, "dim_date"),
    "fact_campaign_performance": ("stg_campaign_metrics", *_DIMS, "dim_date"),
    "dim_campaign_performance_tier": ("fact_campaign_performance",),
    "fact_campaign_summary": ("fact_campaign_performance", "fact_campaign_daily", *_DIMS),
    "fact_user_cohort_analysis": ("stg_user_data",),
    "fact_multi_touch_attribution": ("stg_user_data", "stg_spend"),
    "fact_budget_optimization": ("fact_campaign_performance", *_DIMS),
    **{f"fact_seasonality_{side}": ("fact_campaign_daily", *_DIMS, "dim_date") for side in ("seasonal", "dow", "month", "week", "special")},
    "fact_seasonality_analysis": tuple(f"fact_seasonality_{side}" for side in ("seasonal", "dow", "month", "week", "special")),
    "governance_data_quality": ("fact_campaign_performance", "stg_spend", "stg_user_data", *_DIMS),
    "governance_data_lineage": ("fact_campaign_performance", "fact_campaign_daily", "stg_spend", "stg_user_data"),
}


def edges(spark: SparkSession) -> DataFrame:
    """(model_name, reads): a row for every model that a model reads."""
    return spark.createDataFrame([(m, r) for m, reads in MODEL_INPUTS.items() for r in reads], "model_name string, reads string")


def stored_facts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name, row_count and last_updated of written tables: the latest
    modification time among a table's files. A table without rows has neither
    files' rows nor a time."""
    parts = [spark.read.parquet(path).agg(F.count("*").alias("row_count"), F.max("_metadata.file_modification_time").alias("last_updated"))
             .select(F.lit(name).alias("table_name"), "row_count", "last_updated") for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)
