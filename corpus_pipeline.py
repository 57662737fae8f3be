"""The corpus pipeline: five stages over the documents table, each written as
Parquet and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns that came in. Repeated rows stay repeated rows unless a
stage drops them as duplicates."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acqspark.llm.common import free_name, staged
from acqspark.llm.op10_decontamination import contaminated
from acqspark.llm.op4_quality_rules import quality_rules
from acqspark.llm.op6_minhash import near_duplicates
from acqspark.llm.op7_bpe_lexicon import bpe_codec
from acqspark.llm.op8_line_dedup import line_dedup


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in `ids`; rows without an id stay."""
    name = free_name(docs, "_id")
    return docs.join(ids.select(F.col("doc_id").alias(name)), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules or stand on a rejected host go. An
    id goes with any of its rows; rows without an id are judged as one."""
    verdicts = quality_rules(docs).groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept")
    name = free_name(docs, "_id")
    verdicts = verdicts.select(F.col("doc_id").alias(name))
    return docs.join(verdicts, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line blocks that an earlier document holds go; n_chars follows the text.
    A document that loses all its words this way goes."""
    cleaned = line_dedup(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lines_before", "lines_deleted") if c in docs.columns}))
    cleaned = cleaned.where((F.col("lines_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    cleaned = cleaned.drop("lines_before", "lines_deleted").withColumnsRenamed({f"_own_{c}": c for c in ("lines_before", "lines_deleted")})
    return cleaned.select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document
    with the smallest id stays."""
    verdicts = near_duplicates(docs, shingle_words=5).where("not kept").select("doc_id").distinct()
    return _without(docs, verdicts)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, staged(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("encode", encode)]

#: Patience diff and BPE merges aren't SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
