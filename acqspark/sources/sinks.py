"""Parquet materialization: full rebuilds, date-partitioned facts with
clustering, MERGE-style upserts into touched partitions, CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint directory the cluster names
    (``spark.checkpoint.dir``); never a machine-local temp folder."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "acqspark", *parts])


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str) -> None:
    """Full rebuild (table materialization)."""
    df.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_col: str = "date",
                      cluster_cols: tuple[str, ...] = ("platform_id", "network_id", "campaign_id"),
                      mode: str = "overwrite", replace_all: bool = False, batch_col: str | None = None) -> None:
    """Partition by day, cluster within files. Range partitioning on
    (date, cluster keys) keeps output tasks balanced even when one day is
    much larger than others (a plain repartition(date) would put a whole day
    in one task), and leaves each file sorted for row-group skipping.
    With dynamic partition overwrite only the days present in ``df`` are
    replaced; ``replace_all`` replaces the whole table instead. ``batch_col``
    is a second partition column."""
    keys = [partition_col, *cluster_cols]
    by = [partition_col] + ([batch_col] if batch_col else [])
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
       .write.mode(mode).option("partitionOverwriteMode", "static" if replace_all else "dynamic")
       .partitionBy(*by).parquet(path))


# ------------------------------------------------------------------ MERGE
# Parts of a key locator; a lookup of few keys reads few of them.
LOCATOR_PARTS = 64


def locator_path(path: str) -> str:
    return path.rstrip("/") + "__keys"


def _add_to_locator(spark: SparkSession, path: str, rows: DataFrame, key: str, partition_col: str) -> None:
    """Records where keys now stand. Entries are only added; the latest of a key holds."""
    where = locator_path(path)
    number = (spark.read.parquet(where).agg(F.max("number")).first()[0] or 0) + 1 if table_exists(spark, where) else 1
    part = F.pmod(F.xxhash64(key), F.lit(LOCATOR_PARTS)).cast("int").alias("part")
    entries = rows.select(key, F.col(partition_col).alias("day"), F.lit(number).cast("long").alias("number"), part)
    entries.repartition("part").write.mode("append").partitionBy("part").parquet(where)


def located(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """key and the day at which the table holds it, for those of ``keys`` that it holds."""
    wanted = keys.select(key, F.pmod(F.xxhash64(key), F.lit(LOCATOR_PARTS)).cast("int").alias("part")).distinct()
    entries = spark.read.parquet(locator_path(path)).join(wanted, [key, "part"], "left_semi")
    return entries.groupBy(key).agg(F.max_by("day", "number").alias("day"))


def compact_locator(spark: SparkSession, path: str, key: str) -> None:
    """Leaves the latest entry of every key."""
    from ..session import reliable_checkpoint
    where = locator_path(path)
    latest = spark.read.parquet(where).groupBy("part", key).agg(F.max_by("day", "number").alias("day"), F.max("number").alias("number"))
    (reliable_checkpoint(latest).select(key, "day", "number", "part").repartition("part")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(where))


def merge_into_partitioned(spark: SparkSession, path: str, source: DataFrame, key: str,
                           partition_col: str = "date", **kw) -> None:
    """MERGE by unique key for a date-partitioned Parquet table. The locator
    beside the table (key -> day) names the days at which the source's keys
    stand now, so a restated row that moves to another day leaves its old one.
    Only those days and the source's are read (partition pruning through the
    semi join), merged, cut from their lineage by a reliable checkpoint in
    the cluster's checkpoint folder, and overwritten dynamically; a day that
    loses its last row is removed. Entries are added to the locator after the
    rows are in place, so a run that broke off can be repeated."""
    from ..session import reliable_checkpoint
    source = reliable_checkpoint(source)  # evaluated once: its days, keys and rows agree
    if not table_exists(spark, path):
        write_partitioned(source, path, partition_col, **kw)
        _add_to_locator(spark, path, source, key, partition_col)
        return
    target = spark.read.parquet(path)  # an unreadable table is an error, not a first load
    if not table_exists(spark, locator_path(path)):  # a table from before there were locators
        _add_to_locator(spark, path, target, key, partition_col)
    old = reliable_checkpoint(located(spark, path, source, key))
    touched = source.select(partition_col).unionByName(old.select(F.col("day").alias(partition_col))).distinct()
    current = target.join(touched, partition_col, "left_semi")
    keep = current.join(source.select(key), key, "left_anti")
    merged = reliable_checkpoint(keep.unionByName(source.select(*target.columns)))
    write_partitioned(merged, path, partition_col, **kw)
    emptied = old.select(F.col("day").alias(partition_col)).distinct().join(merged.select(partition_col).distinct(), partition_col, "left_anti")
    for day in emptied.toLocalIterator():  # at most a row per day
        _remove_partition(spark, path, partition_col, day[0])
    _add_to_locator(spark, path, source, key, partition_col)


def _remove_partition(spark: SparkSession, path: str, partition_col: str, value) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_col}={value}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# -------------------------------------------------------------- snapshots
def write_snapshot(df: DataFrame, path: str, day: Column) -> None:
    """The run's rows as the partition ``as_of`` = ``day``; other runs' rows stay."""
    (df.withColumn("as_of", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("as_of").parquet(path))


def previous_snapshot(spark: SparkSession, path: str, as_of) -> DataFrame | None:
    """The rows of the latest snapshot before ``as_of``: the partition names give
    its day, and only that partition is read."""
    from ..functions.metrics import as_date
    if not table_exists(spark, path):
        return None
    stored = spark.read.parquet(path).withColumn("as_of", F.col("as_of").cast("date"))
    day = stored.where(F.col("as_of") < as_date(as_of)).agg(F.max("as_of")).first()[0]
    return None if day is None else stored.where(F.col("as_of") == F.lit(day))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header (one folder of part files; no single-file coalesce)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def with_audit(df: DataFrame, as_of_ts) -> DataFrame:
    """created_at / updated_at as the run's timestamp (never the clock)."""
    ts = as_of_ts.cast("timestamp") if isinstance(as_of_ts, Column) else F.lit(as_of_ts).cast("timestamp")
    return df.withColumns({"created_at": ts, "updated_at": ts})


def store_failures(rows: DataFrame, path: str, run: str) -> None:
    """Adds failing rows (test_name, model, row) to the table of all runs, a
    partition per run and test; a repeated run replaces its own rows."""
    (rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "test_name").parquet(path))
