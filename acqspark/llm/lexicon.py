"""A minimal acyclic transducer from byte strings to token ids.

Strings are added in sorted order to a minimal acyclic automaton (equal
suffixes share states). Each arc carries the number of strings that sort
before those it leads to, so the sum along an accepted path is the string's
rank, and the rank is its row in a table of ids. The arrays go to one file,
which readers memory-map; many strings are walked at once, byte by byte."""

from __future__ import annotations

import struct

import numpy as np

from .common import ragged
from .filesystem import create, open_read

HEAD = struct.Struct("<8sQQQQ")
MAGIC = b"LLMLEX1\n"


def build(entries: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer of sorted, distinct, non-empty strings."""
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the string added last
    previous = b""

    def settle(depth: int) -> None:
        """Replaces the states below `depth` of the last path by equal registered ones."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][previous[len(path) - 1]] = register.setdefault(key, state)

    for string, _ in entries:
        common = 0
        for a, b in zip(string, previous):
            if a != b:
                break
            common += 1
        settle(common)
        for byte in string[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = string
    settle(0)

    # Number the states that are left and count the strings below each.
    order, opened, stack = [], set(), [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            order.append(state)
        elif state not in opened:
            opened.add(state)
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in opened]
    below: dict[int, int] = {}
    for state in order:
        below[state] = int(final[state]) + sum(below[t] for t in arcs[state].values())
    number = {state: i for i, state in enumerate(reversed(order))}
    keys, target, skip = [], [], []
    accept = np.zeros(len(number), np.uint8)
    for state, i in sorted(number.items(), key=lambda x: x[1]):
        accept[i] = final[state]
        before = int(final[state])
        for byte, t in sorted(arcs[state].items()):
            keys.append(i << 8 | byte)
            target.append(number[t])
            skip.append(before)
            before += below[t]
    counts = [len(ids) for _, ids in entries]
    offsets = np.zeros(len(entries) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    ids = np.array([x for _, row in entries for x in row], np.uint32)
    return {"keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64), "offsets": offsets, "ids": ids, "accept": accept}


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    path, out = create(folder, "lexicon", ".fst")
    with out:
        out.write(HEAD.pack(MAGIC, len(arrays["keys"]), len(arrays["offsets"]), len(arrays["ids"]), len(arrays["accept"])))
        for name in ("keys", "target", "skip", "offsets", "ids", "accept"):
            out.write(arrays[name].tobytes())
    return path


class Lexicon:
    def __init__(self, path: str):
        self.file = open_read(path)
        raw = self.file.read_buffer()
        magic, n_arcs, n_offsets, n_ids, n_states = HEAD.unpack(raw[:HEAD.size].to_pybytes())
        if magic != MAGIC:
            raise ValueError(f"{path}: not a lexicon")
        at = HEAD.size

        def take(n, kind):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at) if n else np.zeros(0, kind)
            at += out.nbytes
            return out

        self.keys, self.target, self.skip = (take(n_arcs, np.int64) for _ in range(3))
        self.offsets, self.ids, self.accept = take(n_offsets, np.int64), take(n_ids, np.uint32), take(n_states, np.uint8)

    def ranks(self, strings: list[bytes]) -> np.ndarray:
        """Rank of each string, -1 if the lexicon lacks it."""
        n = len(strings)
        out = np.full(n, -1)
        if not n or not len(self.keys):
            return out
        size = np.fromiter(map(len, strings), np.int64, n)
        data = np.frombuffer(b"".join(strings), np.uint8)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state, rank = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            done = size[live] == depth
            if done.any():
                ends = done & (self.accept[state] == 1)
                out[live[ends]] = rank[ends]
                live, state, rank = live[~done], state[~done], rank[~done]
                if not len(live):
                    break
            key = state << 8 | data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, rank = self.target[at], rank[ok] + self.skip[at]
            depth += 1
        return out

    def take(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given ranks in a row, and how many each has."""
        n = self.offsets[ranks + 1] - self.offsets[ranks]
        return self.ids[ragged(self.offsets[ranks], n)], n
