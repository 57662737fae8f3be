"""Hard-negative mining by threshold joins over an inverted index of vectors.

Anchors go out in blocks of a stated size; every task holds the block and streams
its own vectors past it. For each batch an index in the manner of L2AP is made:
components are put in order of the anchors' weight, and a vector has postings only
from the component on at which the norm of what lies before, times the largest
such norm of an anchor, could reach the lowest threshold. Partial scores are added
up component group by group, heaviest first; a pair goes as soon as its partial
score plus the product of the norms that remain is below its anchor's threshold.
What is left gets its exact integer score.

Positives: the threshold of an anchor is its worst of the best so far. Negatives:
each positive has a window of scores; the first pass looks at its upper part only,
later ones lower the threshold for windows that aren't full yet, down to the lower
edge. A task emits at most the rows asked for of each window.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. Of rows with one id the smallest (label, vector) counts.
Missing components of a shorter vector are 0. Components are whole numbers of
256ths, cut off where a score would leave 64 bits (beyond 2^28 for 64
components). Without anchors, or in an empty table, the result is empty. Other
columns are ignored."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, staged

#: Anchors sent out together: so many, and so many bytes of their components.
BLOCK_ANCHORS, BLOCK_BYTES = 16_384, 32 << 20
#: Part of a window, from its upper edge, that each pass covers.
PASSES = (0.125, 0.25, 0.5, 1.0)
#: Components in one group of the index; anchors and vectors in one tile.
GROUP, TILE_ANCHORS, TILE_ROWS = 8, 256, 4096
_LOWEST = np.int64(-(1 << 62) - 1)
_PAIRS = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and q, the components as whole numbers of 256ths."""
    x = F.col("embedding")
    fit = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit)
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("embedding"), F.lit(1)))
    q = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(F.lit(256.0) * v.cast("double")).cast("double"), most), -most).cast("long"))
    one = rows.select("vec_id", "label", q.alias("q")).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """A row for each vector, 0 where it's too short."""
    if isinstance(q, pa.ChunkedArray):
        q = q.combine_chunks()
    size = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), width), np.int64)
    out[np.repeat(np.arange(len(q)), size), _places(size)] = q.flatten().to_numpy()
    return out


def _places(size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) - np.repeat(ends - size, size)


class _Side:
    """Vectors with their components in index order and the norms of their heads."""

    def __init__(self, q: np.ndarray, order: np.ndarray, edges: np.ndarray):
        self.q = q[:, order]
        self.f = self.q.astype(np.float64)
        squares = np.concatenate([np.zeros((len(q), 1)), np.cumsum(self.f * self.f, axis=1)], axis=1)
        self.norms = np.sqrt(squares[:, edges])

    def take(self, rows) -> _Side:
        out = object.__new__(_Side)
        out.q, out.f, out.norms = self.q[rows], self.f[rows], self.norms[rows]
        return out


def threshold_join(anchors: _Side, rows: _Side, least: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of every pair with a score of its anchor's `least` or more."""
    slack = 1e-9 * (1 + anchors.norms[:, -1:] * rows.norms[:, -1].max(initial=0))
    floor = least.astype(np.float64)[:, None] - slack
    # A row's postings begin with the group before which no anchor can reach the lowest threshold.
    reach = rows.norms[:, 1:] * anchors.norms[:, 1:].max(axis=0, initial=0)
    skipped = (reach < floor.min(initial=np.inf)).sum(axis=1)
    kept = np.flatnonzero(skipped < len(edges) - 1)
    order = kept[np.argsort(skipped[kept], kind="stable")]
    rows, skipped = rows.take(order), skipped[order]
    partial = np.zeros((len(anchors.f), len(order)))
    for g in range(len(edges) - 2, -1, -1):
        n = int(np.searchsorted(skipped, g, "right"))
        of = slice(edges[g], edges[g + 1])
        partial[:, :n] += anchors.f[:, of] @ rows.f[:n, of].T
        if g % 2 == 0 or not g:
            # A row that has no postings here still has its whole head to come.
            head = rows.norms[np.arange(len(order)), np.maximum(skipped, g)]
            alive = partial + anchors.norms[:, np.maximum(skipped, g)] * head >= floor
            if np.count_nonzero(alive) < 0.05 * alive.size or not g:
                break
            some = alive.any(axis=0)
            if not some.all():
                rows, skipped, order, partial = rows.take(some), skipped[some], order[some], partial[:, some]
    a, r = np.nonzero(alive)
    score = np.empty(len(a), np.int64)
    exact = 2.0**53 > anchors.norms[:, -1].max(initial=0) * rows.norms[:, -1].max(initial=0)
    for lo in range(0, len(a), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        score[at] = np.einsum("ij,ij->i", anchors.f[a[at]], rows.f[r[at]]) if exact else np.einsum("ij,ij->i", anchors.q[a[at]], rows.q[r[at]])
    good = score >= least[a]
    return a[good], order[r[good]], score[good]


class _Best:
    """The best `size` of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.score = np.full((slots, size), _LOWEST)
        self.id = np.full((slots, size), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.repeat(touched, self.size)
        slot = np.concatenate([old, slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        ident = np.concatenate([self.id[touched].ravel(), ident])
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < self.size
        self.score[slot[top], rank[top]], self.id[slot[top], rank[top]] = score[top], ident[top]

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > _LOWEST)
        return slot, self.score[slot, place], self.id[slot, place]


class _Block:
    """What a task gets: the anchors, and for negatives the windows of scores
    (row of the anchor, positive, its score, lower and upper edge)."""

    def __init__(self, ids, labels, q, windows=None):
        self.ids, self.labels, self.windows = ids, labels, windows
        self.order = np.argsort((q.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        width = q.shape[1]
        self.edges = np.array([*range(0, width, GROUP), width] if width else [0, 0])
        self.q = q

    def sides(self, width: int, batches: Iterator[pa.RecordBatch]):
        self.anchors = _Side(self.q, self.order, self.edges)
        for b in batches:
            for lo in range(0, b.num_rows, TILE_ROWS):
                part = b.slice(lo, TILE_ROWS)
                yield part["vec_id"].to_numpy(), part["label"].to_numpy(), _Side(_matrix(part["q"], width), self.order, self.edges)


def _pairs(windows, slot, score, ident) -> pa.RecordBatch:
    columns = [windows[0][slot], windows[1][slot], windows[2][slot], ident, score]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split(" ")[0] for f in _PAIRS.split(", ")])


def _positives(batches: Iterator[pa.RecordBatch], shared, width: int, size: int) -> Iterator[pa.RecordBatch]:
    block = shared.value
    best = _Best(len(block.ids), size)
    by_label = {int(v): np.flatnonzero(block.labels == v) for v in np.unique(block.labels)}
    for ids, labels, rows in block.sides(width, batches):
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            of = by_label.get(int(label), np.zeros(0, np.int64))
            for lo in range(0, len(of), TILE_ANCHORS):
                tile = of[lo:lo + TILE_ANCHORS]
                a, r, score = threshold_join(block.anchors.take(tile), rows.take(mine), best.worst[tile], block.edges)
                other = block.ids[tile[a]] != ids[mine[r]]
                best.add(tile[a][other], score[other], ids[mine[r]][other])
    slot, score, ident = best.rows()
    yield _pairs((block.ids, np.zeros_like(block.ids), np.zeros_like(block.ids)), slot, score, ident)


def _negatives(batches: Iterator[pa.RecordBatch], shared, width: int, size: int) -> Iterator[pa.RecordBatch]:
    block = shared.value
    row, positive, at, low, high = block.windows
    best = _Best(len(row), size)
    anchors = np.unique(row)
    spread = np.searchsorted(row, anchors, "left"), np.searchsorted(row, anchors, "right")
    for ids, labels, rows in block.sides(width, batches):
        for lo in range(0, len(anchors), TILE_ANCHORS):
            tile = anchors[lo:lo + TILE_ANCHORS]
            first, last = (s[lo:lo + TILE_ANCHORS] for s in spread)
            least = np.minimum.reduceat(np.maximum(low, best.worst)[first[0]:last[-1]], first - first[0])
            a, r, score = threshold_join(block.anchors.take(tile), rows, least, block.edges)
            other = block.labels[tile[a]] != labels[r]
            a, r, score = a[other], r[other], score[other]
            n = (last - first)[a]
            slot = np.repeat(first[a], n) + _places(n)
            score, ident = np.repeat(score, n), np.repeat(ids[r], n)
            inside = (score >= low[slot]) & (score <= high[slot])
            best.add(slot[inside], score[inside], ident[inside])
    slot, score, ident = best.rows()
    yield _pairs((block.ids[row], positive, at), slot, score, ident)


def _windows(ids: np.ndarray, found: pa.Table, lower: int, upper: int):
    """Windows of negative scores, in order of the anchor, for positives whose window isn't empty."""
    row = np.searchsorted(ids, found["anchor_id"].to_numpy())
    order = np.lexsort((found["vec_id"].to_numpy(), row))
    score = found["score"].to_numpy()[order]
    low = np.array([-(-lower * s // 100) for s in score.tolist()], object)
    high = np.array([upper * s // 100 for s in score.tolist()], object)
    some = np.flatnonzero(low <= high)
    fields = (row[order], found["vec_id"].to_numpy()[order], score, low, high)
    return tuple(f[some].astype(np.int64) for f in fields)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90,
                   block_anchors: int = BLOCK_ANCHORS, passes: tuple[float, ...] = PASSES) -> DataFrame:
    """For each anchor (rows of vec_id, label, q for which `anchor` holds) and
    each of its `positives` best rows of the same label: the `negatives` best rows
    of other labels with lower * positive score <= 100 * score <= upper * positive score."""
    spark = vectors.sparkSession
    vectors = staged(vectors, "vectors")
    asked = staged(vectors.where(anchor), "anchors")
    width = vectors.agg(F.max(F.size("q"))).first()[0] or 0
    size = max(1, min(block_anchors, BLOCK_BYTES // (8 * max(width, 1))))
    folder, written, last = new_folder(spark, "negatives"), False, None
    best = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    while True:
        block = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(size).toArrow()
        if not block.num_rows:
            break
        ids, labels, q = block["vec_id"].to_numpy(), block["label"].to_numpy(), _matrix(block["q"], width)
        last = int(ids[-1])

        def join(step, windows, keep: int) -> DataFrame:
            shared = spark.sparkContext.broadcast(_Block(ids, labels, q, windows))
            pairs = vectors.mapInArrow(functools.partial(step, shared=shared, width=width, size=keep), _PAIRS)
            return pairs.withColumn("rank", best).where(F.col("rank") <= keep)

        windows = _windows(ids, join(_positives, None, positives).select("anchor_id", "vec_id", "score").toArrow(), lower, upper)
        for part in passes:
            if not len(windows[0]):
                break
            row, positive, at, low, high = windows
            from_ = low if part >= 1 else high - np.array([int(math.floor(part * (h - lo))) for lo, h in zip(low.tolist(), high.tolist())], np.int64)
            found = staged(join(_negatives, (row, positive, at, from_, high), negatives), "mined")
            if part >= 1:
                full = found
            else:
                filled = found.groupBy("anchor_id", "positive_id").agg(F.count("*").alias("n")).where(F.col("n") >= negatives).select("anchor_id", "positive_id")
                done = filled.toArrow()
                done = set(zip(done["anchor_id"].to_pylist(), done["positive_id"].to_pylist()))
                left = np.array([(a, p) not in done for a, p in zip(ids[row].tolist(), positive.tolist())], bool)
                windows = tuple(w[left] for w in windows)
                full = found.join(filled, ["anchor_id", "positive_id"], "left_semi")
            full.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
            written = True
    return spark.read.schema(RESULT).parquet(folder) if written else spark.createDataFrame([], RESULT)
