"""Benchmark decontamination by SimHash windows.

Windows as long as a benchmark item slide over each text; their SimHash
fingerprints are looked up among the items of that length through a
multi-index of blocks (fingerprints within the radius differ little in at
least one block, so none is missed); candidates are verified by the exact
weighted similarity of their shingles. Windows that
hold too few shingles of all items together to be similar to any get no
fingerprint. Items are worked on in blocks of bounded size."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, pieces
from .spans import FOLDED, hash_ranges, mix, owner, shingles, words

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit fingerprints in 8 blocks of 8 bits. Equal-sized bags of similarity
#: 0.8 have a cosine of 0.89 and differ in about 10 bits; 24 is five standard
#: deviations more.
BLOCKS, RADIUS = 8, 24
#: Items whose index is broadcast at a time.
ITEMS = 4_096
#: Shingles of a text that are worked on at a time.
STRETCH = 1 << 15

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_COUNT = _BITS.sum(axis=1).astype(np.uint8)


def signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    return (np.unpackbits(mix(values).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) << 1) - 1


def sign_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of the signs; a window's sums are a difference of two rows."""
    sums = np.zeros((len(values) + 1, 64), np.int32)
    np.cumsum(signs(values), axis=0, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The 8 bytes of the SimHash of each window of `size` shingles; a shingle
    weighs as often as it occurs."""
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    return (a & b).total() / (a | b).total() if a or b else 0.0


def _bags(texts: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Words of a shingle and the shingles of each text in order; a text of
    fewer words has one of all."""
    out: list[tuple[int, np.ndarray]] = []
    for _, _, data, off in pieces(texts):
        start, end = words(data, off)
        doc, h = owner(off, start), hash_ranges(data, start, end, FOLDED)
        for d in range(len(off) - 1):
            own = h[np.searchsorted(doc, d):np.searchsorted(doc, d, "right")]
            n = min(SHINGLE, len(own))
            out.append((n, shingles(own, np.zeros(len(own), np.int64), n)[0] if n else np.zeros(0, np.uint64)))
    return out


class ItemIndex:
    """The items of one block, by length in shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        bags = _bags(pa.array([t for _, t in items], pa.string()))
        #: Words of the items' shingles.
        self.words = sorted({n for n, _ in bags} - {0})
        kept = [(i, v) for (i, _), (_, v) in zip(items, bags) if len(v)]
        self.ids = [i for i, _ in kept]
        self.bags = [Counter(v.tolist()) for _, v in kept]
        self.shingles = np.unique(np.concatenate([v for _, v in kept])) if kept else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        near = _COUNT[np.arange(256)[:, None] ^ np.arange(256)] <= RADIUS // BLOCKS
        for size in sorted({len(v) for _, v in kept}):
            members = np.array([k for k, (_, v) in enumerate(kept) if len(v) == size])
            prints = np.concatenate([fingerprints(sign_sums(kept[k][1]), np.zeros(1, np.int64), size) for k in members])
            # table[block, byte] marks the items whose byte there is near enough
            table = np.stack([near[:, prints[:, b]] for b in range(BLOCKS)])
            self.sizes[size] = (members, prints, table)

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.filter[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return at[np.isin(values[at], self.shingles)]

    def matches(self, values: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Items found in one text's shingles: item -> (similarity, first
        shingle, shingles) of the best window (ties: the first). The text is
        gone through in stretches; a window belongs to the one it starts in."""
        best: dict[int, tuple[float, int, int]] = {}
        reach = max(self.sizes)
        base = max(0, int(hits[0]) - reach + 1)
        while base <= hits[-1]:
            near = hits[np.searchsorted(hits, base):np.searchsorted(hits, base + STRETCH + reach)]
            if len(near):
                self._stretch(values[base:base + STRETCH + reach], near - base, base, len(values), best)
            base += STRETCH
        return best

    def _stretch(self, values: np.ndarray, hits: np.ndarray, base: int, total: int, best: dict) -> None:
        sums = sign_sums(values)
        inside = np.zeros(len(values) + 1, np.int64)
        inside[hits + 1] = 1
        np.cumsum(inside, out=inside)
        for size, (members, prints, table) in self.sizes.items():
            width = min(size, total)
            shared = SIMILARITY * (size + width) / (1 + SIMILARITY)  # what similar bags share at least
            starts = np.flatnonzero(inside[width:] - inside[:-width] >= shared - 1e-9)
            starts = starts[starts < STRETCH]
            for lo in range(0, len(starts), 8_192):
                some = starts[lo:lo + 8_192]
                found = fingerprints(sums, some, width)
                candidate = np.zeros((len(some), len(members)), bool)
                for b in range(BLOCKS):
                    candidate |= table[b, found[:, b]]
                w, m = np.nonzero(candidate)
                close = _COUNT[found[w] ^ prints[m]].sum(axis=1) <= RADIUS
                for s, k in zip(some[w[close]].tolist(), members[m[close]].tolist()):
                    if best.get(k, (0.0,))[0] == 1:
                        continue
                    sim = weighted_similarity(Counter(values[s:s + width].tolist()), self.bags[k])
                    if sim >= SIMILARITY and sim > best.get(k, (0.0,))[0]:
                        best[k] = (sim, base + s, width)


def _item_blocks(benchmark: DataFrame):
    """The items in blocks of about ITEMS, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n = -(-items.count() // ITEMS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted((r.item_id, r.text) for r in rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window
    of every item in every text.

    docs: doc_id, text; benchmark: item_id, text (further columns are ignored).
    Items of fewer than five words are one shingle of all their words, and
    match windows of just these words. Null and empty texts and items match
    nothing; items without an id are ignored; repeated items and rows give
    equal results, repeated rows as often as they come; an empty table on
    either side gives none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    schema = pa.schema([(k.split()[0], pa.float64() if k.endswith("double") else pa.int64()) for k in kinds.split(", ")])
    spark = docs.sparkSession
    out = spark.createDataFrame([], kinds)
    for items in _item_blocks(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(items))

        def search(batches, index=index):
            for b in batches:
                for lo, hi, data, off in pieces(b.column("text")):
                    start, end = words(data, off)
                    doc, h = owner(off, start), hash_ranges(data, start, end, FOLDED)
                    rows = []
                    for n in index.value.words:
                        values, first = shingles(h, doc, n)
                        hits = index.value.hits(values)
                        of = doc[first]
                        for d in np.unique(of[hits]).tolist():
                            low, high = np.searchsorted(of, d), np.searchsorted(of, d, "right")
                            own = hits[np.searchsorted(hits, low):np.searchsorted(hits, high)] - low
                            doc_id = b.column("doc_id")[lo + d].as_py()
                            for k, (sim, s, width) in index.value.matches(values[low:high], own).items():
                                rows.append((doc_id, index.value.ids[k], sim, s, width + n - 1))
                    if rows:
                        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], -r[2]))
                        yield batch(schema, *map(list, zip(*rows)))

        out = out.unionByName(docs.mapInArrow(search, kinds))
    return out


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The distinct doc_id of contaminated documents."""
    return contaminated(docs, benchmark).select("doc_id").distinct()
