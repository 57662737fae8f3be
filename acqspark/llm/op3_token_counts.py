"""Token counts through a digest cache.

A cache table keeps the tokens of each (content digest, tokenizer digest).
Counting joins the content digests with it, encodes each distinct miss once,
appends the new counts to the cache and joins them back."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, new_folder, pieces, staged
from .spanmemo import LibraryEncoder

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: str = "text"):
    """SHA-256 of the normalised content. Only null is normalised (to the
    empty text): anything else would change the counts."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""
    schema = pa.schema([("content", pa.string()), ("n_tokens", pa.int64())])

    def count(batches):
        encoder = LibraryEncoder(path, keeps_space=True)
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                yield batch(schema, b.column("content")[lo:hi], encoder.encode(data, off)[1])

    return texts.select("content", "text").mapInArrow(count, "content string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text as the tokenizers library gives them.

    docs: doc_id, text (further columns are ignored). cache_path: a Parquet
    table in a shared folder, made if it's missing; only contents that it
    lacks are encoded, each once, and appended. One row comes out per row:
    null and empty texts have 0 bytes and tokens; repeated rows and texts
    share one cache entry; a null id stays null."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", content_digest().alias("content"))
    tokenizer = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
    misses = docs.select("content", "text").join(cache.select("content"), "content", "left_anti")
    counted = encode_counts(misses.dropDuplicates(["content"]), tokenizer_path)
    counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    known = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == tokenizer)
             .dropDuplicates(["content"]).select("content", "n_tokens"))
    known = staged(known, "token-counts")
    return (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "content")
            .join(known, "content", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def fresh_cache(spark) -> str:
    return new_folder(spark, "token-cache")
