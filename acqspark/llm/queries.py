"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .op1_language_id import language_id
from .op2_archive_conversion import archive_conversion
from .op3_token_counts import fresh_cache, token_counts
from .op4_quality_rules import quality_rules
from .op5_token_files import token_files
from .op6_minhash import near_duplicates
from .op7_bpe_lexicon import bpe_codec
from .op8_line_dedup import line_dedup
from .op9_hilbert_sharding import hilbert_shards
from .op10_decontamination import contaminated
from .op11_prefix_trie import prefix_trie, turn_paths, with_openings
from .op12_toxicity import toxicity
from .op13_hard_negatives import hard_negatives, whole_vectors


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op2_archive_conversion(spark, sf_dir):
    return archive_conversion(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_cache(spark))


def op4_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rejected", "own_failed")


def op5_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark, sf_dir):
    return bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "lines_before", "lines_deleted", "text")


def op9_hilbert_sharding(spark, sf_dir):
    rows = hilbert_shards(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(with_openings(turn_paths(table(spark, sf_dir, "conversations"))))


def op12_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    marked = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = whole_vectors(table(spark, sf_dir, "embeddings").withColumn("label", marked))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_archive_conversion, op3_token_counts, op4_quality_rules, op5_token_files, op6_minhash, op7_bpe_lexicon, op8_line_dedup, op9_hilbert_sharding, op10_decontamination, op11_prefix_trie, op12_toxicity, op13_hard_negatives)}
