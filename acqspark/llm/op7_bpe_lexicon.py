"""BPE encoding and decoding with a compiled lexicon of frequent words.

The words of all documents are counted; the most frequent are merged once and
compiled with their ids into a minimal acyclic transducer in the shared
folder. Tasks memory-map it, look each distinct word up, and merge those that
it lacks. Which words are in the lexicon changes the speed, never an id."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, new_folder, pieces, staged
from .lexicon import Lexicon, build, save
from .spanmemo import SpanMemo, word_spans
from .spans import hash_ranges, owner
from .wordbpe import WordBpe

#: Most words in the lexicon (a bound on the driver's list), and bytes of the
#: longest word that may be one.
LEXICON_WORDS, LEXICON_BYTES = 50_000, 64


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, for words of up to LEXICON_BYTES bytes."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            for _, _, data, off in pieces(b.column("text")):
                start, end = word_spans(data, off)
                short = end - start <= LEXICON_BYTES
                start, end = start[short], end[short]
                _, first, n = np.unique(hash_ranges(data, start, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                yield batch(schema, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], n)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame) -> list[bytes]:
    """The words that occur at least so often that there are LEXICON_WORDS of
    them at most (the limit is found on eighths of powers of two)."""
    counts = staged(word_counts(docs).withColumn("level", F.floor(F.log2("n") * 8)), "word-counts")
    levels = counts.groupBy("level").agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for r in sorted(levels, reverse=True):
        total += r.words
        if total > LEXICON_WORDS:
            break
        least = r.level
    return [] if least is None else sorted(bytes(r.word) for r in counts.where(F.col("level") >= least).select("word").collect())


def build_lexicon(docs: DataFrame, tokenizer_path: str) -> str:
    """Compiles the frequent words into a file in the shared folder."""
    bpe = WordBpe(tokenizer_path)
    return save(new_folder(docs.sparkSession, "lexicon"), build([(w, bpe.encode(w)) for w in frequent_words(docs)]))


class Encoder:
    """Encodes and decodes whole texts with a lexicon and exact merges."""

    def __init__(self, lexicon_path: str, tokenizer_path: str):
        self.lexicon, self.bpe = Lexicon(lexicon_path), WordBpe(tokenizer_path)
        self.tokens = [self.bpe.tokens.get(i, b"") for i in range(max(self.bpe.tokens) + 1)]
        self.memo = SpanMemo(self._spans)

    def _spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ranks = self.lexicon.ranks(spans)
        known = np.flatnonzero(ranks >= 0)
        ids, n = self.lexicon.take(ranks[known]) if len(known) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        stops = np.cumsum(n)
        out: list = [None] * len(spans)
        for i, lo, hi in zip(known.tolist(), (stops - n).tolist(), stops.tolist()):
            out[i] = ids[lo:hi]
        for i in np.flatnonzero(ranks < 0).tolist():
            out[i] = np.array(self.bpe.encode(spans[i]), np.uint32)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = word_spans(data, off)
        ids, n = self.memo.encode(data, start, end)
        counts = np.bincount(owner(off, start), weights=n, minlength=len(off) - 1).astype(np.int64)
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, special ones included, parted by spaces (the
        tokenizer file has no decoder)."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def worker_encoder(lexicon_path: str, tokenizer_path: str) -> Encoder:
    """The encoder of this Python worker: its memo serves the next tasks too,
    and a worker never holds a second one beside it."""
    return Encoder(lexicon_path, tokenizer_path)


def bpe_codec(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: n_tokens and the
    SHA-256 of the ids (little-endian unsigned 32 bits) and of the decoded
    text, with keep_ids also `ids` and `decoded`.

    docs: doc_id, text (further columns are ignored). One row comes out per
    row: null and empty texts have no ids and the empty decoded text; repeated
    rows give equal rows; a null id stays null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = build_lexicon(docs, tokenizer_path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        kinds += ", ids array<long>, decoded string"
    schema = pa.schema(fields)

    def run(batches):
        encoder = worker_encoder(lexicon, tokenizer_path)
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                ids, counts = encoder.encode(data, off)
                rows = np.split(ids, np.cumsum(counts)[:-1])
                decoded = [encoder.decode(r) for r in rows]
                columns = [b.column("doc_id")[lo:hi], counts, [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], [hashlib.sha256(t).hexdigest() for t in decoded]]
                if keep_ids:
                    columns += [[r.astype(np.int64) for r in rows], [t.decode() for t in decoded]]
                yield batch(schema, *columns)

    return docs.mapInArrow(run, kinds)
