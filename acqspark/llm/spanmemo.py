"""Token ids of whole texts from the ids of their distinct spans.

A span is a stretch of text whose borders are always token borders, so that a
text's ids are its spans' ids in a row. Spans are found and hashed by numpy;
each distinct span of a piece is encoded once and kept in a bounded memo."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import ragged
from .spans import BYTES, hash_ranges, owner, words

#: Bounds of a memo; a full one starts anew.
MEMO_SPANS = 2_500_000
MEMO_IDS = 12_000_000


class SpanMemo:
    """encode_spans: bytes of distinct spans -> (ids of all in a row, ids per span)."""

    def __init__(self, encode_spans: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode_spans = encode_spans
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't kept."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        p = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[p] == keys, p, -1)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans data[start:end] in a row, and how many each has."""
        distinct, first, inverse = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MEMO_SPANS or len(self.ids) > MEMO_IDS:
            self._reset()
        new = np.flatnonzero(self._slots(distinct) < 0)
        if len(new):
            raw = data.tobytes()
            f = first[new]
            ids, counts = self.encode_spans([raw[s:e] for s, e in zip(start[f].tolist(), end[f].tolist())])
            at = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            place = np.searchsorted(self.keys, distinct[new])
            self.keys, self.at, self.n = (np.insert(old, place, more) for old, more in ((self.keys, distinct[new]), (self.at, at), (self.n, counts)))
        slot = self._slots(distinct)[inverse]
        return self.ids[ragged(self.at[slot], self.n[slot])], self.n[slot]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans for tokenizers that drop white space: words, parted before a
    comma or full stop after an ASCII letter."""
    return words(data, off, cut_punctuation=True)


def spaced_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans for tokenizers that keep white space: each word with the white
    space before it; what follows a text's last word is a span as well."""
    _, end = words(data, off, cut_punctuation=True)
    end = np.union1d(end, off[1:][off[1:] > off[:-1]])
    return np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end, end


def other_space(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with white space outside ASCII. A run of it may go on in ASCII
    white space, so `spaced_spans` borders aren't safe there."""
    def after(at, n):
        return np.where(at + n < len(data), data[np.minimum(at + n, len(data) - 1)], 0)

    c2, e1, e2, e3 = (np.flatnonzero(data == b) for b in (0xC2, 0xE1, 0xE2, 0xE3))
    third = after(e2, 2)
    found = np.concatenate([
        c2[np.isin(after(c2, 1), (0x85, 0xA0))],
        e1[(after(e1, 1) == 0x9A) & (after(e1, 2) == 0x80)],
        e2[(after(e2, 1) == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))],
        e2[(after(e2, 1) == 0x81) & (third == 0x9F)],
        e3[(after(e3, 1) == 0x80) & (after(e3, 2) == 0x80)],
    ])
    return np.unique(owner(off, found))


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them for their spans
    (special tokens hold no white space, comma or full stop, so no border
    falls into one)."""

    BATCH = 20_000

    def __init__(self, path: str, keeps_space: bool):
        self.tok = load_tokenizer(path)
        self.keeps_space = keeps_space
        self.memo = SpanMemo(self._spans)

    def _spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for k in range(0, len(spans), self.BATCH):
            found = [e.ids for e in self.tok.encode_batch_fast([s.decode() for s in spans[k:k + self.BATCH]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if self.keeps_space:
            start, end = spaced_spans(data, off)
        else:
            start, end = word_spans(data, off)
        doc = owner(off, start)
        whole = other_space(data, off) if self.keeps_space and len(data) and data.max() > 127 else np.zeros(0, np.int64)
        if len(whole):
            keep = ~np.isin(doc, whole)
            start, end, doc = start[keep], end[keep], doc[keep]
        ids, n = self.memo.encode(data, start, end)
        counts = np.bincount(doc, weights=n, minlength=len(off) - 1).astype(np.int64)
        if not len(whole):
            return ids, counts
        parts, lo = [], 0
        direct = {int(d): np.array(self.tok.encode(data[off[d]:off[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for d in whole}
        for d, c in enumerate(counts.tolist()):
            parts.append(direct[d] if d in direct else ids[lo:lo + c])
            lo += c
            counts[d] = len(parts[-1])
        return np.concatenate(parts), counts


@lru_cache(maxsize=1)
def worker_encoder(path: str, keeps_space: bool) -> LibraryEncoder:
    """The encoder of this Python worker: its memo serves the next tasks too."""
    return LibraryEncoder(path, keeps_space)
