"""Line deduplication by pairwise alignment.

Overlapping documents are found through shared lines: each line of enough
words, and each shortest run of consecutive lines that has enough words, leads
to the first document that holds it, so a line that many documents share gives
one pair per document. A block that can be deleted is made up of such runs, and
the first holder of a run is an exact partner for it.
The two documents' shared lines are aligned by patience diff, and aligned
common blocks of enough words are deleted from the later document. The first
holder of a block keeps it."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, free_name, list_array, pieces, release_memory, staged
from .spans import BYTES, SPACE, hash_ranges, hash_runs, lines

#: A block is deleted if it has so many words; a shorter line is no evidence.
BLOCK_WORDS = 10
#: Lines whose runs are worked out at a time; a document with more is one piece.
PIECE_LINES = 1 << 18
#: Pairs of documents turned into Python lists at once.
ALIGNED_ROWS = 512


def line_arrays(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, number, hash (without white space at the ends) and words of each
    line with a word."""
    doc, lo, hi = lines(data, off)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    sums = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(inside, out=sums[0, 1:])
    np.cumsum(begins, out=sums[1, 1:])
    full = sums[0, hi] > sums[0, lo]
    doc, number, lo, hi = doc[full], number[full], lo[full], hi[full]
    at = np.flatnonzero(inside)
    first, last = at[sums[0, lo]], at[sums[0, hi] - 1] + 1
    n_words = sums[1, hi] - sums[1, lo]
    n_words += inside[lo] & ~begins[lo]  # a word that starts a text right behind another text's last one
    return doc, number, hash_ranges(data, first, last, BYTES), n_words


def block_runs(doc: np.ndarray, number: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (behind the last line) of the shortest runs of consecutive
    lines of one document that have block_words words: the one from each line
    on and the one up to each line. Together they cover every longer block."""
    n, least = len(words), max(1, block_words)
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(words, out=sums[1:])
    stretch = np.zeros(n, np.int64)
    np.cumsum((doc[1:] != doc[:-1]) | (number[1:] != number[:-1] + 1), out=stretch[1:])
    at = np.arange(n)
    start = np.concatenate([at, np.searchsorted(sums, sums[1:] - least, "right") - 1])
    end = np.concatenate([np.searchsorted(sums, sums[:-1] + least), at + 1])
    inside = (start >= 0) & (end <= n)
    start, end = start[inside], end[inside]
    whole = stretch[start] == stretch[end - 1]
    run = np.unique(start[whole] * (n + 1) + end[whole])
    return run // (n + 1), run % (n + 1)


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs ascending in both places (pairs come sorted by the first)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = top_at[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            top_at.append(i)
        else:
            tops[k], top_at[k] = b, i
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Items in their longest common order: those that occur once on each
    side, or if there are none, the n-th occurrence with the n-th."""
    def places(x: list[int], lo: int, hi: int) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i in range(lo, hi):
            out.setdefault(x[i], []).append(i)
        return out

    in_a, in_b = places(a, alo, ahi), places(b, blo, bhi)
    both = [(v, in_b[h]) for h, v in in_a.items() if h in in_b]
    once = [(v[0], w[0]) for v, w in both if len(v) == len(w) == 1]
    return _chain(sorted(once or [p for v, w in both for p in zip(v, w)]))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal items: equal ends first, then the items of
    `_common`, then the gaps between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        chain = _common(a, b, alo, ahi, blo, bhi)
        if chain:
            out += chain
            for (i, j), (k, l) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)]):
                if i + 1 < k and j + 1 < l:
                    todo.append((i + 1, k, j + 1, l))
    return sorted(out)


def _in_runs(a: tuple[list, list], d: tuple[list, list, list], block_words: int) -> set[int]:
    """Line numbers of d in `block_runs` that a holds anywhere."""
    n_words = dict(zip(d[1], d[2]))
    held = [(i, h, n_words[h]) for i, h in zip(*a) if h in n_words]
    runs = []
    for number, h, n in (zip(*held) if held else ([],) * 3, d):
        start, end = block_runs(np.zeros(len(n), np.int64), np.array(number, np.int64), np.array(n, np.int64), block_words)
        runs.append((start, end, hash_runs(np.array(h, np.int64).view(np.uint64), start, end)))
    (_, _, known), (start, end, keys) = runs
    found = np.isin(keys, known)
    return {d[0][k] for s, e in zip(start[found].tolist(), end[found].tolist()) for k in range(s, e)}


def deleted_lines(a: tuple[list, list], d: tuple[list, list, list], block_words: int) -> list[int]:
    """Line numbers of the later document that lie in aligned blocks. a and d:
    numbers and hashes of shared lines; d also has words. A block goes on
    while both sides' numbers go up by one. What is left of the later
    document is aligned again, which finds moved and repeated blocks. A line
    aligned in too short a block may lie in a longer one elsewhere; then the
    later document's `block_runs` are looked up among the earlier one's."""
    gone: list[int] = []
    whole, short = d, False
    while aligned := patience(a[1], d[1]):
        run: list[int] = []
        total, last = 0, None
        for i, j in aligned:
            if last is None or a[0][i] != last[0] + 1 or d[0][j] != last[1] + 1:
                gone += run if total >= block_words else []
                short |= 0 < total < block_words
                run, total = [], 0
            run.append(d[0][j])
            total += d[2][j]
            last = (a[0][i], d[0][j])
        gone += run if total >= block_words else []
        short |= total < block_words
        taken = {j for _, j in aligned}
        d = tuple([x for j, x in enumerate(column) if j not in taken] for column in d)
    return gone + sorted(_in_runs(a, whole, block_words).difference(gone)) if short else gone


def _lines(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark, numbers (line numbers), hashes, words of the
    lines with a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("numbers", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])

    def split(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                doc, number, h, n = line_arrays(data, off)
                counts = np.bincount(doc, minlength=hi - lo)
                yield batch(schema, b.column("doc_id")[lo:hi], b.column("mark")[lo:hi], *[list_array(x, counts, pa.int64()) for x in (number, h.view(np.int64), n)])

    return docs.mapInArrow(split, "doc_id long, mark long, numbers array<long>, hashes array<long>, words array<long>")


def _run_keys(texts: DataFrame, block_words: int) -> DataFrame:
    """(doc, key): the hash of each of the `block_runs` of two or more lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64())])

    def keys(batches):
        for b in batches:
            counts = b.column("nth").value_lengths().to_numpy(zero_copy_only=False)
            nth, h, n = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nth", "hash", "words"))
            off = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=off[1:])
            lo = 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE_LINES, "right")) - 1)
                part = slice(off[lo], off[hi])
                row = np.repeat(np.arange(lo, hi), counts[lo:hi])
                start, end = block_runs(row, nth[part], n[part], block_words)
                many = end - start > 1
                start, end = start[many], end[many]
                of = pa.array(row[start])
                yield batch(schema, b.column("doc_id").take(of), b.column("mark").take(of), hash_runs(h[part].view(np.uint64), start, end).view(np.int64))
                lo = hi
        release_memory()

    flat = texts.select("doc.doc_id", "doc.mark", F.col("lines.nth").cast("array<long>").alias("nth"), F.col("lines.hash").alias("hash"), F.col("lines.words").alias("words"))
    return flat.mapInArrow(keys, "doc_id long, mark long, key long").select(F.struct("doc_id", "mark").alias("doc"), "key")


def deletions(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, mark, gone): the numbers of the lines to delete."""
    rows = _lines(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    rows = staged(rows.dropDuplicates(["doc_id", "mark"]), "lines")
    line = rows.select(F.struct("doc_id", "mark").alias("doc"), F.posexplode(F.arrays_zip("numbers", "hashes", "words")).alias("nth", "l"))
    line = line.select("doc", "nth", F.col("l.numbers").alias("number"), F.col("l.hashes").alias("hash"), F.col("l.words").alias("words"))
    spread = line.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last")
    shared = staged(spread.select("hash", "first"), "shared-lines")
    # only lines that two documents share can be aligned
    common = staged(line.join(shared, "hash"), "common-lines")
    texts = staged(common.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", "number", "hash", "words"))).alias("lines")), "common-texts")
    single = common.where((F.col("words") >= block_words) & (F.col("first") != F.col("doc"))).select("first", "doc")
    both = _run_keys(texts, block_words)
    firsts = staged(both.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last").select("key", "first"), "shared-runs")
    double = both.join(firsts, "key").where(F.col("first") != F.col("doc")).select("first", "doc")
    pairs = staged(single.unionByName(double).distinct(), "overlaps")
    aligned = (pairs.join(texts.select(F.col("doc").alias("first"), F.col("lines").alias("a")), "first")
               .join(texts.select("doc", F.col("lines").alias("d")), "doc")
               .select("doc.doc_id", "doc.mark", F.col("a.nth").alias("an"), F.col("a.hash").alias("ah"), F.col("d.nth").alias("dn"), F.col("d.hash").alias("dh"),
                       F.col("d.words").alias("dw"), F.col("d.number").alias("dl")))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("gone", pa.list_(pa.int64()))])

    def align(batches):
        for b in (whole.slice(lo, ALIGNED_ROWS) for whole in batches for lo in range(0, whole.num_rows, ALIGNED_ROWS)):
            keep, gone = [], []
            rows = zip(*[b.column(c).to_pylist() for c in ("an", "ah", "dn", "dh", "dw", "dl")])
            for k, (an, ah, dn, dh, dw, dl) in enumerate(rows):
                number = dict(zip(dn, dl))
                if found := deleted_lines((an, ah), (dn, dh, dw), block_words):
                    keep.append(k)
                    gone.append([number[i] for i in found])
            if keep:
                yield batch(schema, b.column("doc_id").take(keep), b.column("mark").take(keep), gone)
        release_memory()

    found = aligned.mapInArrow(align, "doc_id long, mark long, gone array<long>")
    return staged(found.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "deletions")


def line_dedup(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Deletes from every text the aligned blocks that an earlier one holds.

    docs: doc_id, text; all columns come through, with `text` cleaned and two
    more: `lines_before` and `lines_deleted` (columns of these names are
    replaced). Earlier means a smaller doc_id, then a smaller hash of the
    text; rows that repeat an id and text are one document. Null texts and
    rows with a null id come through as they are, and null ids are never
    the earlier side. A text may become empty. An empty table stays empty."""
    mark = F.xxhash64("text")
    gone = deletions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark")), block_words)
    whose, which, lost = (free_name(docs, c) for c in ("_gone_id", "_gone_mark", "_gone"))
    gone = gone.select(F.col("doc_id").alias(whose), F.col("mark").alias(which), F.col("gone").alias(lost))
    split = F.split("text", "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(lost, i.cast("long"))), "\n")
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col(whose)) & (mark == F.col(which)), "left")
    return (joined.withColumn("lines_before", F.coalesce(F.size(split), F.lit(0)).cast("long"))
            .withColumn("lines_deleted", F.coalesce(F.size(lost), F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(left))
            .drop(whose, which, lost))
