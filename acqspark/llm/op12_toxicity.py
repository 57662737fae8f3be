"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and
one of ordinary text, compress every window of a text; the difference of the two
lengths says which text it is like.

Windows are six words, three words apart (`text` in lower case, runs of white
space as one space, words cut after 48 bytes). Both dictionaries start with what
the zstandard trainer finds in ordinary text, as toxic text is mostly ordinary
prose too. The toxic one ends with the beginnings of words that toxic texts hold
at four times the rate of ordinary ones and by more than chance; the ordinary one
has neither these nor any others in their place, so the distance of everything
else is the same in both. (The stock trainer ranks by frequency alone and fills
both dictionaries with the same prose.) The shares of windows that save 2, 3, 4,
5, 6 or 8 bytes, and their numbers, are weighed by a logistic regression: these are
the calibrated thresholds.

Learning uses at most TOXIC_ROWS toxic and ORDINARY_ROWS ordinary texts, distinct
ones in the order of a hash, each whole; rates are weighted back to the numbers of
labelled texts. Copies with different labels count as toxic if half of them are.

Defined results: null and empty texts are scored like a text without windows;
a null doc_id is not held out and has no label; a repeated row is repeated; in an
empty table the result is empty; without toxic or without ordinary rows to learn
from every score is the share of toxic ones (0 without any). Other columns are
ignored."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, pieces, ragged, staged
from .spans import SPACE

#: Distinct texts of each kind that are learned from.
TOXIC_ROWS, ORDINARY_ROWS = 4096, 8192
WINDOW_WORDS, STEP_WORDS, WORD_BYTES = 6, 3, 48
DICTIONARY_BYTES, LEVEL = 32 << 10, 3
#: Windows of an ordinary text, spread over it, for the trainer.
TRAINER_WINDOWS = 10
#: Bytes of the beginnings of words; least share of toxic texts; least ratio of rates; least deviation.
BEGINNINGS, LEAST_SHARE, LEAST_RATIO, LEAST_SIGMAS = range(4, 13), 0.03, 4.0, 6.0
MOST_BEGINNINGS = 2048
SAVED = (2, 3, 4, 5, 6, 8)
LIMIT = 0.7


def _folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each and one space for any run of white space."""
    n = len(off) - 1
    at = off[:-1] + np.arange(n)
    out = np.full(len(data) + n, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = np.where(SPACE[data], 32, data)
    space = out == 32
    keep = ~space
    keep[at] = True
    keep[1:] |= ~space[:-1]
    keep[at] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], ends[np.append(at, len(out))]


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte (its space, or the cut in a long word), end and text of each word."""
    space = data == 32
    begin = np.flatnonzero(space & ~np.append(space[1:], True))
    edge = np.flatnonzero(np.append(space, True))
    end = edge[np.searchsorted(edge, begin + 1)]
    owner = np.searchsorted(off, begin, "right") - 1
    end = np.minimum(end, off[owner + 1])
    parts = np.maximum(1, -(-(end - begin) // WORD_BYTES))
    first = np.repeat(begin, parts) + WORD_BYTES * ragged(np.zeros(len(parts), np.int64), parts)
    return first, np.minimum(first + WORD_BYTES, np.repeat(end, parts)), np.repeat(owner, parts)


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each window; a text with words has one at least."""
    first, end, owner = _words(data, off)
    n_words = np.bincount(owner, minlength=len(off) - 1)
    n = np.where(n_words > 0, 1 + -(-np.maximum(n_words - WINDOW_WORDS, 0) // STEP_WORDS), 0)
    base = np.repeat(np.cumsum(n_words) - n_words, n)
    at = base + STEP_WORDS * ragged(np.zeros(len(n), np.int64), n)
    last = np.minimum(at + WINDOW_WORDS, base + np.repeat(n_words, n)) - 1
    return first[at], end[last], np.repeat(np.arange(len(n)), n)


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes):
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                                                          write_content_size=False, write_checksum=False, write_dict_id=False)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _lengths(content: bytes, data: bytes, segments: np.ndarray) -> np.ndarray:
    """Compressed bytes of the segments (offset, length) of `data`."""
    if not len(segments):
        return np.zeros(0, np.int64)
    done = _compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()))
    if hasattr(done, "segments"):
        return np.frombuffer(done.segments(), np.uint64).reshape(-1, 2)[:, 1].astype(np.int64)
    return np.fromiter((len(x) for x in done), np.int64, len(done))


def features(raw: np.ndarray, off: np.ndarray, dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """A row per text: windows, numbers and shares of windows by bytes saved, mean saving."""
    data, off = _folded(raw, off)
    start, end, text = _windows(data, off)
    segments = np.stack([start, end - start], axis=1).astype(np.uint64)
    buffer = data.tobytes()
    toxic, ordinary = dictionaries
    saved = _lengths(ordinary, buffer, segments) - _lengths(toxic, buffer, segments)
    n = np.bincount(text, minlength=len(off) - 1)
    at_least_one = np.maximum(n, 1)
    out = [np.log(at_least_one)]
    for least in SAVED:
        count = np.bincount(text[saved >= least], minlength=len(n))
        out += [np.log1p(count), 10 * count / at_least_one, count > 0, count > 1]
    out.append(np.maximum(np.bincount(text, saved, len(n)) / at_least_one, 0))
    return np.stack(out, axis=1).astype(np.float64)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and ordinary texts hold each beginning of a word."""
    toxic, ordinary = Counter(), Counter()
    for b in batches:
        for text, is_toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            found = set()
            for word in set((text or "").split()):
                raw = b" " + word.encode("utf-8", "replace")
                found.update(raw[:n + 1] for n in BEGINNINGS if len(raw) > n and (len(raw) == n + 1 or raw[n + 1] & 0xC0 != 0x80))
            (toxic if is_toxic else ordinary).update(found)
    keys = list(toxic.keys() | ordinary.keys())
    for lo in range(0, len(keys), 1 << 16):
        k = keys[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([toxic[x] for x in k], pa.int64()), pa.array([ordinary[x] for x in k], pa.int64())],
                                         names=["beginning", "toxic", "ordinary"])


def _trainer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring windows of the ordinary texts, TRAINER_WINDOWS spread over each."""
    for b in batches:
        for _, _, raw, off in pieces(b["text"]):
            data, off = _folded(raw, off)
            start, end, text = _windows(data, off)
            n = np.bincount(text, minlength=len(off) - 1)
            k = np.minimum(n, TRAINER_WINDOWS)
            base = np.cumsum(n) - n
            at = np.repeat(base, k) + ragged(np.zeros(len(k), np.int64), k) * np.repeat(n, k) // np.maximum(np.repeat(k, k), 1)
            to = np.minimum(at + 2, np.repeat(base + n, k) - 1)
            buffer = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([buffer[s:e] for s, e in zip(start[at].tolist(), end[to].tolist())], pa.binary())], names=["window"])


def _dictionaries(windows: list[bytes], beginnings: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    try:
        ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        ordinary = b"".join(windows)[:DICTIONARY_BYTES] or bytes(8)
    for b in sorted(beginnings, key=len, reverse=True):
        ordinary = ordinary.replace(b, b" " * len(b))
    toxic = b"".join(beginnings)
    return ordinary + toxic, ordinary + bytes(len(toxic))


def _kept_beginnings(held: dict[bytes, int]) -> list[bytes]:
    """Of beginnings (with their numbers of toxic texts) the longest that still
    stand for most of a shorter one, rarer ones first."""
    longer: dict[bytes, list[bytes]] = {}
    for b in held:
        for n in range(1, len(b)):
            if b[:n] in held:
                longer.setdefault(b[:n], []).append(b)
    whole = [b for b in held if not any(held[x] >= 0.7 * held[b] for x in longer.get(b, []))]
    inside = set(whole)
    whole = [b for b in whole if not any(b[:n] in inside for n in range(1, len(b)))]
    return sorted(whole, key=lambda b: (held[b], b))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: means, scales, weights with the constant last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.ones(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w - np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * w)
    return mean, scale, w


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    dictionaries, model = shared.value
    for b in batches:
        for lo, hi, raw, off in pieces(b["text"]):
            x = features(raw, off, dictionaries)
            if model is None:
                score = pa.array([None] * (hi - lo), pa.float64())
                held = list_array(x.ravel(), np.full(hi - lo, x.shape[1]), pa.float64())
            else:
                mean, scale, w = model
                score = pa.array(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30))))
                held = pa.nulls(hi - lo, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], score, held], names=["doc_id", "score", "features"])


def _scored(texts: DataFrame, dictionaries, model=None) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((dictionaries, model))
    return texts.select("doc_id", "text").mapInArrow(functools.partial(_score_batches, shared=shared), "doc_id long, score double, features array<double>")


def toxicity(documents: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id modulo `folds` is `fold`; never learned
    from), score and predicted of each row of `documents`."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.where(remainder != fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("key")).distinct().join(marks, "doc_id")
    texts = staged(texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).alias("toxic")), "labelled")
    number = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = number.get(True, 0), number.get(False, 0)
    held = F.coalesce(remainder == fold, F.lit(False)).alias("held_out")
    if not n_toxic or not n_ordinary:
        scored = docs.withColumn("score", F.lit(1.0 if n_toxic else 0.0))
        return scored.select("doc_id", held, "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))

    drawn = [texts.where(F.col("toxic") == t).orderBy(F.xxhash64("key"), "key").limit(n) for t, n in ((True, toxic_rows), (False, ordinary_rows))]
    drawn = drawn[0].unionByName(drawn[1])  # at most toxic_rows + ordinary_rows rows of three numbers
    sample = docs.withColumn("key", F.xxhash64("text")).join(F.broadcast(drawn), ["doc_id", "key"]).dropDuplicates(["key"])
    sample = staged(sample.select("doc_id", "text", "toxic"), "sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    windows = [bytes(r["window"]) for r in sample.where("NOT toxic").select("text").mapInArrow(_trainer_windows, "window binary").collect()]
    windows.sort(key=lambda w: (zlib.crc32(w), w))
    rate = (F.col("ordinary") + 1) / F.lit(size[False]) * size[True]
    counts = sample.select("text", "toxic").mapInArrow(_beginnings, "beginning binary, toxic long, ordinary long").groupBy("beginning").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = counts.where((F.col("toxic") >= max(5, LEAST_SHARE * size[True])) & (F.col("toxic") >= LEAST_RATIO * rate) & (F.col("toxic") - rate >= LEAST_SIGMAS * F.sqrt(rate)))
    found = found.orderBy(F.desc("toxic"), "beginning").limit(MOST_BEGINNINGS).collect()
    beginnings = _kept_beginnings({bytes(r["beginning"]): r["toxic"] for r in found})
    dictionaries = _dictionaries(windows, beginnings)

    known = _scored(sample, dictionaries).join(sample.select("doc_id", "toxic"), "doc_id").select("features", "toxic").toArrow()
    y = known["toxic"].to_numpy(zero_copy_only=False).astype(np.float64)
    x = known["features"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    weight = np.where(y == 1, n_toxic / size[True], n_ordinary / size[False])
    model = _fit(x, y, weight * len(y) / weight.sum())
    return _scored(docs, dictionaries, model).select("doc_id", held, "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
