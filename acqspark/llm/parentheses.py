"""Balanced parentheses with a range min-max tree, by whole numpy arrays.

A tree in preorder is a row of brackets: 1 opens a node, 0 closes it. The excess
at a position is the number of nodes still open there. Blocks of the excess keep
their minimum, and a binary tree stands over the block minima."""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Queries scanned together inside blocks.
_CHUNK = 1 << 14
_FAR = np.int32(np.iinfo(np.int32).max)


class BalancedParentheses:
    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int32) - 1, dtype=np.int32)
        n_blocks = max(1, -(-len(bits) // BLOCK))
        padded = np.full(n_blocks * BLOCK, _FAR)
        padded[:len(bits)] = self.excess
        self._blocks = padded.reshape(n_blocks, BLOCK)
        self._minima = [self._blocks.min(axis=1)]
        while len(self._minima[-1]) > 1:
            low = self._minima[-1]
            if len(low) % 2:
                low = np.append(low, _FAR)
            self._minima.append(low.reshape(-1, 2).min(axis=1))

    def opens_through(self, at: np.ndarray) -> np.ndarray:
        """How many nodes open at positions 0 to `at`."""
        return (at + 1 + self.excess[at]) // 2

    def leaf_pairs(self) -> np.ndarray:
        """Per position: whether "()" starts there."""
        out = self.bits == 1
        out[:-1] &= self.bits[1:] == 0
        if len(out):
            out[-1] = False
        return out

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing position of the nodes that open at `opens`: the first
        later position whose excess is below the one at the opening."""
        target = self.excess[opens]
        found = np.full(len(opens), -1, np.int64)
        self._scan(opens // BLOCK, opens % BLOCK + 1, target, found, np.arange(len(opens)))
        rest = np.flatnonzero(found < 0)
        if len(rest):
            block = self._next_block(opens[rest] // BLOCK, target[rest])
            self._scan(block, np.zeros(len(rest), np.int64), target[rest], found, rest)
        return found

    def _scan(self, block, first, target, found, rows) -> None:
        column = np.arange(BLOCK)
        for lo in range(0, len(rows), _CHUNK):
            cut = slice(lo, lo + _CHUNK)
            hit = (self._blocks[block[cut]] < target[cut, None]) & (column >= first[cut, None])
            some = hit.any(axis=1)
            found[rows[cut][some]] = block[cut][some] * BLOCK + hit[some].argmax(axis=1)

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block after `block` whose minimum is below `target`: up
        until a right sibling holds one, then down to its leftmost."""
        at, level = block.copy(), np.zeros(len(block), np.int64)
        going = np.arange(len(block))
        for k, low in enumerate(self._minima):
            sibling = at[going] + 1
            there = (at[going] % 2 == 0) & (sibling < len(low))
            hit = there.copy()
            hit[there] = low[sibling[there]] < target[going[there]]
            done = going[hit]
            at[done] += 1
            level[done] = k
            going = going[~hit]
            at[going] //= 2
        for k in range(len(self._minima) - 1, 0, -1):
            rows = np.flatnonzero(level >= k)
            if len(rows):
                left = 2 * at[rows]
                at[rows] = left + (self._minima[k - 1][left] >= target[rows])
        return at


class RangeMinimum:
    """Minimum of values[lo:hi] for many ranges, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self._table = [values]
        step = 1
        while 2 * step <= len(values):
            low = self._table[-1]
            self._table.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        size = hi - lo
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(lo), self._table[0].dtype)
        for k, low in enumerate(self._table):
            rows = np.flatnonzero(level == k)
            out[rows] = np.minimum(low[lo[rows]], low[hi[rows] - (1 << k)])
        return out
