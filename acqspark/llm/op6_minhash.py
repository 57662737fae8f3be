"""Near-duplicate groups by circulant MinHash.

A document's set holds its distinct word shingles. All signature coordinates
come from two permutations of 32-bit numbers: the first shuffles the shingles,
the second is shifted circularly by k for coordinate k. Bands of the signature
give buckets; pairs are confirmed on the full sets.

Documents with equal sets are one class. A bucket isn't expanded into pairs:
its members are compared with its hub (the member that meets the most others),
what is linked is contracted, and only members that are then still in
different components, and can be similar by parity sketches of their sets, are
compared with each other, so no link is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, list_array, pieces, staged
from .components import components
from .spans import FOLDED, hash_ranges, mix, owner, shingles, words

#: 30 bands of 5: a pair of similarity 0.8 shares no bucket with a chance of 7e-6.
BANDS, ROWS = 30, 5
#: Shingles worked on at a time, so that the arrays stay in the cache.
_BLOCK = 1 << 15
#: Bits of a set's parity sketch, in words of 64.
PARITY_WORDS = 16


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each
    text has. A text of fewer than n words has one shingle of all its words."""
    start, end = words(data, off)
    doc = owner(off, start)
    h = hash_ranges(data, start, end, FOLDED)
    value, first = shingles(h, doc, n)
    of = doc[first]
    count = np.bincount(doc, minlength=len(off) - 1)
    for k in range(1, n):
        at = np.flatnonzero(count == k)
        if len(at):
            whole, first = shingles(h, doc, k)
            own = np.isin(doc[first], at)
            value, of = np.concatenate([value, whole[own]]), np.concatenate([of, doc[first][own]])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[keep], np.bincount(of[keep], minlength=len(off) - 1)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (multiply and xor-shift steps)."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` coordinates for each non-empty set."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), size), np.uint32)
    place = (mix(values) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    stops = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        base = stops[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(stops, base + _BLOCK, "right")))
        part, cuts = place[base:stops[hi - 1]], stops[lo:hi] - counts[lo:hi] - base
        for k in range(size):
            out[lo:hi, k] = np.minimum.reduceat(second_permutation(part + np.uint32(k)), cuts)
        lo = hi
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = acc
    return out


def set_ids(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits that depend on the set alone; None for an empty one."""
    some = np.flatnonzero(counts > 0)
    out: list[bytes | None] = [None] * len(counts)
    if len(some):
        cuts = (np.cumsum(counts) - counts)[some]
        a = np.add.reduceat(mix(values), cuts)
        b = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), cuts)
        raw = np.stack([a, b], axis=1).astype(">u8").tobytes()
        for i, d in enumerate(some.tolist()):
            out[d] = raw[16 * i:16 * i + 16]
    return out


def parities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of PARITY_WORDS words for each set: each shingle flips one bit.
    Two sketches differ in no more bits than there are shingles that only one
    of the sets has."""
    size = 64 * PARITY_WORDS
    bit = (mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(size)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty((len(counts), PARITY_WORDS), np.int64)
    for lo in range(0, len(counts), 2048):
        hi = min(lo + 2048, len(counts))
        at = np.repeat(np.arange(hi - lo) * size, counts[lo:hi]) + bit[stops[lo]:stops[hi]]
        odd = (np.bincount(at, minlength=(hi - lo) * size) & 1).astype(np.uint8)
        out[lo:hi] = np.packbits(odd).view(np.int64).reshape(hi - lo, PARITY_WORDS)
    return out


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id, bands of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                values, counts = shingle_sets(data, off, n)
                keys = band_keys(signatures(values, counts, BANDS * ROWS), BANDS, ROWS)
                yield batch(schema, b.column("doc_id")[lo:hi], counts, pa.array(set_ids(values, counts), pa.binary()),
                            list_array(keys.view(np.int64).ravel(), np.where(counts > 0, BANDS, 0), pa.int64()))

    return staged(docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketches")


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, hashes, parity) of the classes in `wanted` (node, set_id, id), once each."""
    schema = pa.schema([("set_id", pa.binary()), ("hashes", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))  # noqa: E731  a class may have null ids only

    def sets(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                values, counts = shingle_sets(data, off, n)
                yield batch(schema, pa.array(set_ids(values, counts), pa.binary()), list_array(values.view(np.int64), counts, pa.int64()),
                            list_array(parities(values, counts).ravel(), np.full(len(counts), PARITY_WORDS), pa.int64()))

    rows = docs.select(key("doc_id").alias("_k"), "text").join(wanted.select(key("id").alias("_k")).distinct(), "_k", "left_semi")
    found = rows.select("text").mapInArrow(sets, "set_id binary, hashes array<long>, parity array<long>")
    return staged(found.join(wanted.select("set_id", "node"), "set_id").dropDuplicates(["set_id"]).drop("set_id"), "full-sets")


def similar(shared: Column, a: Column, b: Column) -> Column:
    return 100 * shared >= 80 * (a + b - shared)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with the sizes nu, nv of their full sets and how many
    shingles both have."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv"))
    return staged(pairs.select("u", "v").join(right, "v").join(left, "u")
                  .select("u", "v", F.size("hu").alias("nu"), F.size("hv").alias("nv"), F.size(F.array_intersect("hu", "hv")).alias("shared")), "compared")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(similar(F.col("shared"), F.col("nu"), F.col("nv"))).select("u", "v")


def _members(classes: DataFrame) -> DataFrame:
    """(band, node, n_shingles, size) of the classes in buckets of two or more."""
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = staged(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared-buckets")
    return staged(banded.join(shared, "band"), "members")


def _with_hubs(members: DataFrame) -> DataFrame:
    """The members (band, node, n_shingles) with their bucket's hub."""
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))  # a node has at most BANDS rows
    hubs = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node", "n_shingles")).alias("hub"))
    return staged(members.join(staged(hubs, "hubs"), "band").select("band", "node", "n_shingles", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("n_hub")), "hubbed")


def _sized(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("u") != F.col("v")) & (100 * F.least("nu", "nv") >= 80 * F.greatest("nu", "nv"))).select("u", "v").distinct()


def _split_members(hubbed: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with `root` and
    the words p0, p1, ... of their parity sketch."""
    rooted = staged(hubbed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("band")
    split = staged(rooted.join(staged(mixed, "mixed"), "band", "left_semi"), "split-members")
    words = sets.select("node", *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_WORDS)])
    return staged(split.select("band", "node", "root", "n_shingles").join(words, "node"), "split")


def _rest_pairs(split: DataFrame) -> DataFrame:
    """Pairs of one bucket in different components that can be similar: similar
    sets differ in no more than a ninth of their shingles together, nor then in
    more bits of their sketches, which rules most pairs out without their sets."""
    a, b = (split.select("band", F.col("node").alias(s), F.col("root").alias(f"r{s}"), F.col("n_shingles").alias(f"n{s}"),
                         *[F.col(f"p{k}").alias(f"p{k}{s}") for k in range(PARITY_WORDS)]) for s in "uv")
    bits = sum((F.bit_count(F.col(f"p{k}u").bitwiseXOR(F.col(f"p{k}v"))) for k in range(PARITY_WORDS)), F.lit(0))
    return _sized(a.join(b, "band").where((F.col("ru") < F.col("rv")) & (9 * bits <= F.col("nu") + F.col("nv"))))


def near_duplicates(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    docs: doc_id, text (further columns are ignored). Texts whose shingle sets
    have a Jaccard similarity of 0.8 or more are linked; component_id is the
    smallest doc_id reachable. Null texts and texts without a word have no
    shingle, are linked with nothing and kept. Rows that repeat an id and text
    get equal results. Null ids count as larger than any other; a component of
    null ids alone has a null component_id and is kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _sketches(docs, shingle_words)
    # a class is a node named by its smallest id, so a component's smallest node has its smallest id
    node = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "set_id")
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("node", node), "classes")
    members = _members(classes)
    wanted = classes.join(members.select(F.col("node.set_id").alias("set_id")).distinct(), "set_id", "left_semi")
    sets = _full_sets(docs, wanted, shingle_words)
    hubbed = _with_hubs(members)
    compared = _compared(_sized(hubbed.select(F.col("hub").alias("u"), F.col("n_hub").alias("nu"), F.col("node").alias("v"), F.col("n_shingles").alias("nv"))), sets)
    roots = staged(components(_links(compared)), "roots")
    rest = _compared(_rest_pairs(_split_members(hubbed, roots, sets)), sets)
    links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(_links(rest))
    least = F.coalesce("root", "node")
    named = classes.select("set_id", "node").join(components(links), "node", "left").select("set_id", F.when(~least["no_id"], least["id"]).alias("least"))
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
