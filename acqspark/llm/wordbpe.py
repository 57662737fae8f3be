"""Exact byte-pair merges of single words, by the rules of a word-level BPE
file: NFC, lower case, split into contractions, letters, single digits and
other signs, byte symbols, a mark on the last symbol of a word."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex

from .spanmemo import load_tokenizer

#: Beyond these code points the library's own normaliser and splitter are
#: asked, since tables of newer scripts differ between Unicode versions.
_KNOWN = re.compile("[\x00-ɏ]*")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte: itself where it is a
    printable Latin-1 sign, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._marked = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.vocab = vocab | self.special
        #: Text of each id as UTF-8; what decoding puts in a row.
        self.tokens = {i: t.encode() for t, i in self.vocab.items()}
        signs = byte_symbols()
        self.symbol = [vocab[s] for s in signs]
        self.last = [vocab[s + suffix] for s in signs]
        self.from_sign = {s: b for b, s in enumerate(signs)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.library = load_tokenizer(path)

    def pretokens(self, text: str) -> list[bytes]:
        if _KNOWN.fullmatch(text):
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
            return [w.encode() for w in _SPLIT.findall("".join(map(str.lower, text)) if not text.isascii() else text.lower())]
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.from_sign.__getitem__, w)) for w, _ in shown]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged
        until no pair has a rule."""
        symbol = self.symbol
        ids = [symbol[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > 48:
            return self._merge_long(ids)
        find = self.merges.get
        pairs = [find(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return ids
            ids[at:at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = find((ids[at - 1], ids[at]))
            if at < len(pairs):
                pairs[at] = find((ids[at], ids[at + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for long words."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        find = self.merges.get
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if p := find((new, ids[right[i]])):
                    heapq.heappush(heap, (p[0], i, new, ids[right[i]], p[1]))
            if left[i] >= 0 and (p := find((ids[left[i]], new))):
                heapq.heappush(heap, (p[0], left[i], ids[left[i]], new, p[1]))
        return [x for x, ok in zip(ids, alive) if ok]

    def encode(self, span: bytes) -> list[int]:
        """Ids of a span between white space: special tokens first, then words."""
        text = span.decode()
        if self._marked is None or "<" not in text:
            return [i for w in self.pretokens(text) for i in self.merge(w)]
        out, lo = [], 0
        for m in self._marked.finditer(text):
            out += [i for w in self.pretokens(text[lo:m.start()]) for i in self.merge(w)]
            out.append(self.special[m[0]])
            lo = m.end()
        return out + [i for w in self.pretokens(text[lo:]) for i in self.merge(w)]
