"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to a few bits each; a row's cell is numbered
along the Hilbert curve; rows are sorted by that number and the order is cut
into runs of equal row counts, so that each shard covers a compact region of
all dimensions and file statistics prune on any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS = 5


def quantile_bins(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Bin of a number between the approximate quantiles of its column (2^bits
    - 1 of them, a bounded list); null is in bin 0."""
    parts = 1 << bits
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bins = F.lit(0)
    for c in cuts:
        bins = bins + (F.col(column) > F.lit(c)).cast("int")
    return F.coalesce(bins, F.lit(0))


def category_bins(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Bin of a category by the place of its value among the sorted distinct
    values (each has its own where there are no more than bins), so that
    neighbours on the axis are neighbours in order; null is in bin 0. The least
    value of each bin, 2^bits at most, is all that the driver gets."""
    parts = 1 << bits
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    places = ordered_positions(values, ["value"]).select(F.expr(f"position * {parts} div total").cast("int").alias("bin"), "value")
    out = F.lit(0)
    for r in sorted(places.groupBy("bin").agg(F.min("value").alias("least")).collect(), key=lambda r: r.bin):
        out = F.when(F.col(column) >= F.lit(r.least), r.bin).otherwise(out)
    return out.cast("int")


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the cell with these coordinates of `bits`
    bits: undo the excess rotations from the top bit down, Gray-code the
    axes, interleave their bits."""
    n = len(axes)
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def rotate(acc, q):
        x = [acc[f"x{i}"] for i in range(n)]
        low = q - 1
        x[0] = F.when(x[0].bitwiseAND(q) != 0, x[0].bitwiseXOR(low)).otherwise(x[0])
        for i in range(1, n):
            hit = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            x[0], x[i] = F.when(hit, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(swap)), F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(swap))
        return F.struct(*[c.alias(f"x{i}") for i, c in enumerate(x)])

    turned = F.aggregate(steps, F.struct(*[a.cast("int").alias(f"x{i}") for i, a in enumerate(axes)]), rotate)

    def interleave(acc):
        x = [acc["x0"]]
        for i in range(1, n):
            x.append(acc[f"x{i}"].bitwiseXOR(x[-1]))
        flip = F.aggregate(steps, F.lit(0), lambda t, q: F.when(x[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(x[i].bitwiseXOR(flip), b).bitwiseAND(F.lit(1)).cast("long")
                out = out + F.shiftleft(bit, b * n + n - 1 - i)
        return out

    return F.transform(F.array(turned), interleave)[0]


def ordered_positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `position` (0, 1, ... in order of the keys over the whole table)
    and `total`: rows are dealt out by range and sorted, the numbering within
    the written partitions is kept, and the sizes of earlier partitions (one
    row per partition, so bounded by the partition count) are added."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = staged(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                      .withColumn("_part", F.spark_partition_id())
                      .withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part")
    offsets = sizes.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return (numbered.join(F.broadcast(offsets), "_part")
            .withColumn("position", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before"))


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deals all rows into `shards` runs of the curve over (size, lang,
    source); counts differ by one at most.

    docs: doc_id, text, lang, source (further columns are ignored). Gives
    doc_id, size, text_crc32, curve, shard and slot (0, 1, ... within the
    shard). Equal texts are one group with one cell, that of the least lang and
    the least source among them. Null texts have size 1 and the checksum of the empty text; null
    dimensions fall into bin 0; ties on the curve go by checksum, size and id,
    so that equal texts are neighbours and a crowded cell is still cut; repeated rows are dealt out as rows; fewer rows than shards leave
    shards empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), "lang", "source")
    # written, so that a group of very many rows can be split where the rows are joined with it
    groups = staged(rows.groupBy("_text", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source")), "groups")
    axes = [quantile_bins(rows, "size"), category_bins(rows, "lang"), category_bins(rows, "source")]
    rows = rows.drop("lang", "source").join(groups, ["_text", "size"])
    cells = rows.select("doc_id", "size", "text_crc32", hilbert_index(axes).alias("curve"))
    at = ordered_positions(cells, ["curve", "text_crc32", "size", "doc_id"])
    shard = F.expr(f"position * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the first position of a shard
    return (at.withColumn("shard", shard).withColumn("slot", (F.col("position") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a table with the columns of hilbert_shards, one folder per
    shard, in curve order, so that readers prune files by their statistics."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
