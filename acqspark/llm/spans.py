"""Words and lines of UTF-8 texts with 64-bit hashes, by whole numpy arrays.

A range of bytes is hashed by a polynomial of random byte values over the
integers modulo 2^64, taken from running sums, then mixed with its length. Two
different words or lines share a hash with a chance near 2^-64."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
#: The same with A-Z as a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]

_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, _CHUNK + 4096), base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Hashes of data[start:end] for ascending ranges that don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
        top = int(end[j - 1])
        up, down = _power(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(table[data[base:top]] * up[:top - base], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:end] of hashes; runs may overlap."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, cut_punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of all texts (text i is
    data[off[i]:off[i + 1]]). cut_punctuation: also part a word before a comma
    or full stop that follows an ASCII letter."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[off] = True
    begins[1:-1] |= ~inside[:-1]
    if cut_punctuation:
        begins[1:-1] |= ((data[1:] == 44) | (data[1:] == 46)) & LETTER[data[:-1]]
    starts = inside & begins[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:] | starts[1:]
    after[off[1:][off[1:] > 0] - 1] = True
    return np.flatnonzero(starts), np.flatnonzero(inside & after) + 1


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end byte of each \\n-split line, empty ones included."""
    at = np.flatnonzero(data == 10)
    begin = np.concatenate([off[:-1], at + 1])
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, at, "right") - 1])
    order = np.lexsort((begin, doc))
    doc, begin = doc[order], begin[order]
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - 1
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end[last] = off[1:]
    return doc, begin, end


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each byte position belongs to."""
    return np.searchsorted(off, at, "right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of each run of n words within one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(hashes) - n + 1
    acc = np.zeros(k, np.uint64)
    for i in range(n):
        acc = mix(acc * _BASE + hashes[i:i + k] + np.uint64(i + 1))
    first = np.flatnonzero(doc[:k] == doc[n - 1:])
    return acc[first], first
