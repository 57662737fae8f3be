"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. ANSI mode makes division by zero an error,
# which is why every ratio goes through ``functions.metrics.safe_ratio``.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "acqspark", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, submit with the cluster's own conf;
    ``configure`` below applies the per-session SQL settings there."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession, initial_partitions: int | None = None,
              advisory_partition_bytes: str = "128m") -> SparkSession:
    """Apply the runtime SQL settings to an existing session (cluster use).

    On a cluster, pass ``initial_partitions`` (a few times the total core
    count): every shuffle starts that wide, so no partition has to hold a
    large share of a 100 TB shuffle, and AQE coalesces small ones back to
    about ``advisory_partition_bytes`` at runtime."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory_partition_bytes)
    if initial_partitions:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions))
        spark.conf.set("spark.sql.shuffle.partitions", str(initial_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) create a private scratch folder for it."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="acqspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def reliable_checkpoint(df):
    """Eager reliable checkpoint into the session's checkpoint folder (never
    a local checkpoint: a lost executor must not lose the data)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
