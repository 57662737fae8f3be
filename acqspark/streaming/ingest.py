"""Streaming ingestion of spend lines and installs.

Every row that arrives is kept, however late: there is no watermark and no
stateful deduplication. Rows with a source row id (``src_id``) are MERGEd on
it into the date-partitioned staging table, so a re-delivered row is harmless
and a restated one replaces what it restates, on its old day too. Rows without
one are appended, each micro-batch once: a batch owns the partitions (day,
stream and batch), a ledger beside the table names the batches that are done,
and one that broke off is written again over its own partitions. A stream is
known by an id kept in its checkpoint, so other sources and new checkpoints
count their batches apart. ``refresh_daily`` then recomputes the days a batch
touched and overwrites them in the daily fact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging, daily
from ..session import reliable_checkpoint
from ..sources import sinks
from ..sources.seeds import SPEND_SCHEMA

KINDS = {
    # kind: (staging builder, event-date column, clustering columns)
    "spend": (staging.stg_spend, "date", ("platform", "network_name", "campaign_name")),
    "user_data": (staging.stg_user_data, "install_date", ("platform", "network_name", "campaign_name")),
}


def stage_stream(stream: DataFrame, kind: str) -> DataFrame:
    """Keyed staging rows, stateless."""
    return KINDS[kind][0](stream)


def ledger_path(table_path: str) -> str:
    return table_path.rstrip("/") + "__ledger"


LEDGER = "stream string, batch bigint, rows bigint, days array<string>"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to, made at its first start."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream_id")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(at, False)
        out.writeUTF(uuid.uuid4().hex)
        out.close()
    read = fs.open(at)
    try:
        return read.readUTF()
    finally:
        read.close()


def append_batch(spark: SparkSession, batch: DataFrame, stream: str, batch_id: int, path: str, date_col: str, cluster) -> None:
    """Appends a micro-batch exactly once, whatever became of earlier attempts."""
    ledger = ledger_path(path)
    if sinks.table_exists(spark, ledger):
        done = spark.read.schema(LEDGER).json(ledger)
        if not done.filter((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
            return
    rows = reliable_checkpoint(batch)
    sinks.write_partitioned(rows.withColumn("batch", F.lit(f"{stream}-{batch_id}")), path, date_col, cluster, batch_col="batch")
    entry = rows.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.col(date_col).cast("string"))).alias("days"))
    (entry.select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch"), "rows", "days")
     .coalesce(1).write.mode("append").json(ledger))


def start_staging_stream(spark: SparkSession, kind: str, source_dir: str, table_path: str,
                         schema=None, checkpoint: str | None = None, available_now: bool = True,
                         on_batch=None):
    """Read new Parquet files of ``kind`` from ``source_dir`` and bring each
    micro-batch into the partitioned staging table at ``table_path``. The
    stream's checkpoint lives under the cluster's shared checkpoint folder
    unless given. ``on_batch(batch_df, batch_id)`` runs after each merge
    (e.g. ``refresh_daily`` for the touched days)."""
    _, date_col, cluster = KINDS[kind]
    if schema is None:
        schema = spark.read.parquet(source_dir).schema if kind != "spend" else SPEND_SCHEMA
    stream = spark.readStream.schema(schema).parquet(source_dir)
    staged = stage_stream(stream, kind)

    ckpt = checkpoint or sinks.scratch_path(spark, "streams", kind)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        if "src_id" in batch.columns:
            rows = staging.dedupe_latest(batch, "src_id", date_col)
            sinks.merge_into_partitioned(spark, table_path, rows, "src_id", partition_col=date_col, cluster_cols=cluster)
        else:
            append_batch(spark, batch, stream_id(spark, ckpt), batch_id, table_path, date_col, cluster)
        if on_batch is not None:
            on_batch(batch, batch_id)

    writer = staged.writeStream.foreachBatch(merge_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def refresh_daily(spark: SparkSession, stg_spend: DataFrame, stg_users: DataFrame, dims: dict,
                  touched_days: DataFrame, daily_path: str) -> None:
    """Recompute the daily fact for the days in ``touched_days`` (one column
    ``date``) from the staging tables and overwrite them in ``daily_path``. The
    semi joins restrict both staging scans to those days (partition pruning
    when staging is stored by date)."""
    days = touched_days.select("date").distinct()
    s = stg_spend.join(days, "date", "left_semi")
    u = stg_users.join(days.withColumnRenamed("date", "install_date"), "install_date", "left_semi")
    fresh = daily.campaign_daily(daily.spend_user_full_outer(daily.daily_spend(s), daily.daily_users(u)),
                                 dims["campaign"], dims["network"], dims["platform"], dims["date"])
    sinks.write_partitioned(reliable_checkpoint(fresh), daily_path)
