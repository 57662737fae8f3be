"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is
parsed greedily into the longest phrases that occur in that language's
training text; c phrases over m symbols against n training symbols give the
cross entropy estimate c * log2(n) / m. The language with the least wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, pieces

#: Bounds of the training sample: texts per language (the first by hash, copies
#: once), and the windows taken from one, spread over the whole text.
SAMPLE_ROWS, ROW_WINDOWS, WINDOW_SYMBOLS = 200, 2, 60
#: Distinct labels that may be learned; more is an error, not a cut.
MAX_LANGUAGES = 256
#: Symbols that are parsed side by side with those of other blocks, and after how
#: many a block that began in another state is compared with its first parse.
BLOCK, MEET = 256, 32
PAD, SPACE, OTHER = 0, 1, 2

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, phrases long, symbols long"


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text (null: empty text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _windows(text: str = "text"):
    """The windows of a text: all of a short one, else ROW_WINDOWS from its start to its end."""
    cleaned = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    room = F.greatest(F.length(cleaned) - WINDOW_SYMBOLS, F.lit(0))
    at = [F.floor(room * i / max(ROW_WINDOWS - 1, 1)).cast("int") + 1 for i in range(ROW_WINDOWS)]
    apart = F.concat_ws(" ", *[F.substring(cleaned, a, F.lit(WINDOW_SYMBOLS)) for a in at])
    return F.when(F.length(cleaned) <= ROW_WINDOWS * WINDOW_SYMBOLS, cleaned).otherwise(apart)


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Up to SAMPLE_ROWS (lang, windows) of each language, a bounded list in the
    order of lang and hash of the windows, so that copies count once. The first
    of each language are taken of every part of the table, then of all parts."""
    rows = (docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
            .select("lang", _windows().alias("text")).withColumn("_hash", F.xxhash64("text")))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    distinct = rows.groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    parts = distinct.withColumn("_part", F.pmod("_hash", F.lit(64))).withColumn("_nth", rank("lang", "_part")).where(F.col("_nth") <= SAMPLE_ROWS)
    found = parts.withColumn("_nth", rank("lang")).where(F.col("_nth") <= SAMPLE_ROWS).select("lang", "_hash", "text").limit(MAX_LANGUAGES * SAMPLE_ROWS + 1).collect()
    if len({r.lang for r in found}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    return [(r.lang, r.text) for r in sorted(found, key=lambda r: (r.lang, r._hash))]


def _symbols(texts: list[str]) -> list[str]:
    """Lower-case letters; each run of anything else is one space."""
    return ["".join(c.lower() if c.isalpha() else " " for c in t) for t in texts]


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Transitions, suffix links and lengths of the states; 0 is the root."""
    arcs, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return arcs, link, length


class Transitions:
    """An automaton's arcs as rows laid over each other: the arc of state s by
    symbol c lies at base[s] + c if that slot is owned by s. The size follows
    the number of arcs, whatever the alphabet. State 0: no phrase is open."""

    def __init__(self, arcs: list[dict[str, int]], code: dict[str, int], width: int):
        rows = [sorted((code[c], t) for c, t in own.items()) for own in arcs]
        self.root = np.zeros(width, np.int32)
        for c, t in rows[0]:
            self.root[c] = t
        base, owner, target = [0] * len(arcs), [-1] * (2 * width), [0] * (2 * width)
        free, low = width, 0
        for s in sorted(range(1, len(arcs)), key=lambda s: -len(rows[s])):
            own = rows[s]
            if not own:
                continue
            if len(own) == 1:  # any free slot will do
                while owner[free] >= 0:
                    free += 1
                    if free + width >= len(owner):
                        owner += [-1] * len(owner)
                        target += [0] * len(target)
                at = free - own[0][0]
            else:
                at = max(0, low - 32)
                while any(owner[at + c] >= 0 for c, _ in own):
                    at += 1
                    if at + 2 * width >= len(owner):
                        owner += [-1] * len(owner)
                        target += [0] * len(target)
                low = at
            base[s] = at
            for c, t in own:
                owner[at + c], target[at + c] = s, t
        top = max(base) + width
        self.base, self.owner, self.target = np.array(base, np.int32), np.array(owner[:top], np.int32), np.array(target[:top], np.int32)

    def run(self, grid: np.ndarray, state: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Follows each column of symbols from its state, adding the phrases that begin; the states reached."""
        for row in grid:
            at = self.base.take(state)
            at += row
            on = self.owner.take(at) == state
            count += ~on & (row != PAD)
            state = np.where(on, self.target.take(at), self.root.take(row))
        return state


class CrossParser:
    """The automata of all languages, each over its own letters."""

    def __init__(self, sample: list[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(" ".join(_symbols([text])[0].split()))
        self.langs = sorted(texts)
        letters = sorted(set("".join("".join(t) for t in texts.values())) - {" "})
        code = {" ": SPACE} | {c: OTHER + 1 + i for i, c in enumerate(letters)}
        #: Symbol of each code point: a number for every letter that any language has.
        self.symbol = np.full(0x110000, SPACE, np.uint8 if len(code) < 250 else np.uint16)
        for p in range(0x110000):
            c = chr(p)
            if c.isalpha():
                self.symbol[p] = code.get(c, code.get(c.lower(), OTHER))
        #: Per language: its own numbers of the symbols, transitions, bits a phrase.
        self.own, self.automata, self.bits = [], [], []
        for lang in self.langs:
            text = " ".join(texts[lang])
            mine = {" ": SPACE} | {c: OTHER + 1 + i for i, c in enumerate(sorted(set(text) - {" "}))}
            own = np.full(OTHER + 1 + len(letters), OTHER, np.int32)
            own[PAD] = PAD
            for c, k in mine.items():
                own[code[c]] = k
            self.own.append(own)
            self.automata.append(Transitions(suffix_automaton(text)[0], mine, OTHER + 1 + len(mine)))
            self.bits.append(float(np.log2(max(2, len(text)))))

    def parse(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text by language, symbols and letters of each text.

        Texts are cut into blocks that are parsed side by side, each as if a
        phrase began with it; then every block is parsed again from the state
        in which the one before it ended, until it meets its first parse."""
        n = len(off) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=place[1:])
        bounds = place[off]
        sym = self.symbol[points]
        doc = np.repeat(np.arange(n), np.diff(bounds))
        keep = sym != SPACE
        keep[1:] |= (sym[:-1] != SPACE) & (doc[1:] == doc[:-1])
        sym, doc = sym[keep], doc[keep]
        size = np.bincount(doc, minlength=n)
        letters = np.bincount(doc[sym != SPACE], minlength=n)
        blocks = -(-size // BLOCK)
        at = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
        lane = np.repeat(np.cumsum(blocks) - blocks, size) + at // BLOCK
        grid = np.zeros((BLOCK, int(blocks.sum())), sym.dtype)
        grid[at % BLOCK, lane] = sym
        of = np.repeat(np.arange(n), blocks)
        follows = np.zeros(len(of), bool)
        follows[1:] = of[1:] == of[:-1]
        phrases = np.zeros((len(self.langs), n), np.int64)
        for k, (own, automaton) in enumerate(zip(self.own, self.automata)):
            local = own.take(grid)
            head = np.zeros(len(of), np.int32)  # phrases that begin in the first MEET symbols
            met = automaton.run(local[:MEET], np.zeros(len(of), np.int32), head)
            tail = np.zeros(len(of), np.int32)
            end = automaton.run(local[MEET:], met, tail)
            begun = np.zeros(len(of), np.int32)  # the state each block was last parsed from
            while True:
                due = np.flatnonzero(follows)
                due = due[end[due - 1] != begun[due]]
                if not len(due):
                    break
                begun[due] = end[due - 1]
                count = np.zeros(len(due), np.int32)
                state = automaton.run(local[:MEET, due], begun[due], count)
                head[due] = count
                apart = state != met[due]
                due, state = due[apart], state[apart]
                if len(due):
                    met[due] = state
                    count = np.zeros(len(due), np.int32)
                    end[due] = automaton.run(local[MEET:, due], state, count)
                    tail[due] = count
            phrases[k] = np.bincount(of, weights=head + tail, minlength=n)
        return phrases, size, letters

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (ties: the first by name), score = 1 - least / second
        least entropy, phrases of the winner and symbols, for each text."""
        n = len(off) - 1
        if not self.langs or not n:
            return ["und"] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        phrases, size, letters = self.parse(data, off)
        entropy = phrases * np.array(self.bits)[:, None] / np.maximum(size, 1)
        best = entropy.argmin(axis=0)
        least = entropy[best, np.arange(n)]
        second = np.sort(entropy, axis=0)[1] if len(self.langs) > 1 else np.full(n, np.inf)
        score = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
        none = letters == 0
        return (["und" if x else self.langs[b] for b, x in zip(best.tolist(), none.tolist())], np.where(none, 0.0, score),
                np.where(none, 0, phrases[best, np.arange(n)]), size)


def language_id(docs: DataFrame) -> DataFrame:
    """Predicts the language of every whole text.

    docs: doc_id, text, lang (further columns are ignored). Learns from a
    bounded sample of rows with text and lang that aren't held out. One row
    comes out per row. Null and empty texts and those without a letter give
    `und` and score 0, as do all rows if there's nothing to learn from; a null
    id counts as the empty text in `held_out`; equal entropies go to the first
    language by name; repeated rows are predicted alike."""
    docs = docs.select("doc_id", "text", "lang")
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(training_sample(docs)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrases", pa.int64()), ("symbols", pa.int64())])

    def predict(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                lang, score, phrases, symbols = parser.value.predict(data, off)
                yield batch(schema, b.column("doc_id")[lo:hi], b.column("held_out")[lo:hi], lang, score, phrases, symbols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(predict, SCHEMA)
