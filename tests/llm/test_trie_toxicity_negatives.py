"""op11 and op13 against plain Python, op12 on held-out rows, with nulls, empty
and long values, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from acqspark.llm.op11_prefix_trie import prefix_trie, turn_paths, with_openings  # noqa: E402
from acqspark.llm.op12_toxicity import _folded, _windows, toxicity  # noqa: E402
from acqspark.llm.op13_hard_negatives import hard_negatives, whole_vectors  # noqa: E402
from acqspark.llm.parentheses import BalancedParentheses, RangeMinimum  # noqa: E402


def _key(row):
    return tuple((x is not None, x) for x in row)


def test_find_close_and_minimum():
    r = random.Random(1)
    for n in (1, 2, 31, 64, 500, 3000):
        bits, open_ = [], 0
        for _ in range(n):  # deep runs, so that closing brackets lie many blocks away
            up = r.randint(1, 200) if r.random() < 0.02 else 1
            bits += [1] * up
            open_ += up
            down = min(open_, r.choice([0, 1, 1, 2, 150]))
            bits += [0] * down
            open_ -= down
        bits = np.array(bits + [0] * open_)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        tree = BalancedParentheses(bits)
        assert tree.find_close(opens).tolist() == [want[i] for i in opens.tolist()]
        assert int(tree.leaf_pairs().sum()) == sum(want[i] == i + 1 for i in want)
    values = np.array([r.randint(0, 99) for _ in range(100)])
    lo = np.array([r.randint(0, 98) for _ in range(300)])
    hi = np.array([r.randint(x + 1, 100) for x in lo])
    assert RangeMinimum(values).of(lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi)]


def _plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
        ends = sorted(c for c in members[s] if rebuilt[c] == s)
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=_key)


TALK = "conv_id long, turn long, role string, text string, kind int, shard long, path string, first long"


def _talk(r):
    rows = []
    for c in [*range(0, 330), -5, -100, -205, 40_001]:  # 40,001 has no conversation that opens it
        for t in range(90 if c % 37 == 36 else r.choice([1, 1, 2, 3, 6, 8])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "é𝒳" * 4])))
    for c in range(1000, 1400):  # one conversation a third of all times
        rows += [(c, t, "user", "same") for t in range(6)]
    return rows + rows[:9] + [(None, 1, "user", "no id")]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 13), (200, 100), (60, 20)])
def test_trie(spark, sizes):
    rows = _talk(random.Random(3))
    talk = spark.createDataFrame([(*x, 1, 2, "p", 3) for x in rows], TALK).repartition(5)
    got = prefix_trie(with_openings(turn_paths(talk)), *sizes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=_key) == _plain_trie(rows)


def test_trie_without_rows_or_turns_shared(spark):
    assert prefix_trie(with_openings(turn_paths(spark.createDataFrame([], TALK)))).count() == 0
    # Conversation 6 has h = 5 turns of conversation 0, which has none beyond its own: it may end up without turns.
    rows = [(c, 0, "user", "x") for c in range(1, 60)]
    talk = spark.createDataFrame([(*x, 1, 2, "p", 3) for x in rows], TALK)
    got = sorted(map(tuple, prefix_trie(with_openings(turn_paths(talk)), 8, 4).collect()), key=_key)
    assert got == _plain_trie(rows) and got[0][1] == 0


def _plain_negatives(rows, every):
    best = {}
    for v, label, x in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [math.floor(256 * float(np.float32(c))) for c in x]
        if v not in best or (label, q) < best[v]:
            best[v] = (label, q)
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        score = {v: sum(x * y for x, y in zip(q, p)) for v, (_, p) in best.items() if v != a}
        order = sorted(score, key=lambda v: (-score[v], v))
        for p in [v for v in order if best[v][0] == label][:5]:
            inside = [v for v in order if best[v][0] != label and 30 * score[p] <= 100 * score[v] <= 90 * score[p]]
            out += [(a, p, k + 1, v, score[p], score[v]) for k, v in enumerate(inside[:10])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, q string, score int, rank string"


@pytest.mark.parametrize("block, clusters", [(16_384, 0), (7, 0), (7, 6)])
def test_hard_negatives(spark, block, clusters):
    r = np.random.default_rng(5)
    x = r.normal(0, 0.2, (600, 24)).astype(np.float32)
    if clusters:  # vectors about a few directions, most partial scores far from their thresholds
        x = (r.normal(0, 1, (clusters, 24))[np.arange(600) % clusters] + 0.3 * x).astype(np.float32)
    rows = [(i, int(r.integers(0, 3)) if i % 3 else 1, v.tolist()) for i, v in enumerate(x)]
    rows += [(600 + i, 1 + i % 2, x[20].tolist()) for i in range(300)]  # one vector a third of all times, ties
    rows += [(2000, None, x[0].tolist()), (2010, 1, None), (2020, 1, [None] * 24), (2030, 2, [math.nan] * 24), (2040, 2, [math.inf] + [0.1] * 23),
             (2050, 1, []), (2060, 2, x[3].tolist()[:9]), (None, 1, x[1].tolist()), (20, 2, x[9].tolist()), (2070, 9, x[5].tolist())]
    rows += rows[:30]
    table = spark.createDataFrame([(v, e, label, "q", 1, "r") for v, label, e in rows], VECTORS).repartition(4)
    got = hard_negatives(whole_vectors(table), F.col("vec_id") % 10 == 0, block_anchors=block)
    assert sorted(map(tuple, got.collect())) == _plain_negatives(rows, 10)


def test_hard_negatives_without_rows_or_with_large_components(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(whole_vectors(none), F.col("vec_id") % 10 == 0).count() == 0
    rows = [(i, [3e6 + i, 2e6 - i], i % 2, "q", 1, "r") for i in range(30)]  # scores beyond 2^53
    plain = [(v, label, e) for v, e, label, *_ in rows]
    got = hard_negatives(whole_vectors(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 10 == 0, lower=-300, upper=300)
    assert {(a, p) for a, p, *_ in map(tuple, got.collect())} == {(a, p) for a in (0, 10, 20) for p in [v for v, label, _ in _ranked(plain, a) if label == 0][:5]}


def _ranked(rows, anchor):
    q = {v: [math.floor(256 * float(np.float32(c))) for c in x] for v, _, x in rows}
    return sorted((r for r in rows if r[0] != anchor), key=lambda r: (-sum(x * y for x, y in zip(q[anchor], q[r[0]])), r[0]))


DOCS = "doc_id long, text string, score string, toxic string, key int, features int"
MARKS = "doc_id long, toxic int, quality int"


def _texts():
    r = random.Random(11)
    parts = ["ka", "lo", "mi", "ren", "sta", "vu", "pel", "or", "ith", "dan"]
    prose = lambda n: [("".join(r.choice(parts) for _ in range(r.randint(1, 4)))) for _ in range(n)]
    bad = ["grobnak", "zwilfud", "Quaxbert"]
    docs, marks = [], []
    for i in range(900):
        words = prose(r.randint(20, 200))
        if i % 5 == 0:
            for _ in range(max(3, len(words) // 20)):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        docs.append((i, " ".join(words)))
        if i % 3 != 0 or i % 2:
            marks.append((i, int(i % 5 == 0)))
    return docs, marks


def test_toxicity(spark):
    docs, marks = _texts()
    extra = [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "x" * 200_000), (2004, "kalo miren " * 30_000), (None, "grobnak zwilfud kalo"), (7, docs[7][1])]
    docs_df = spark.createDataFrame([(*d, "s", "t", 1, 2) for d in docs + extra], DOCS).repartition(4)
    marks_df = spark.createDataFrame([(*m, 1) for m in marks] + [(2001, 0, 1), (None, 1, 1), (5, None, 1), (marks[0][0], marks[0][1], 0)], MARKS)
    got = toxicity(docs_df, marks_df)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 900]
    assert np.mean([g.predicted == int(g.doc_id % 5 == 0) for g in held]) > 0.95
    empty = [g.score for g in got if g.doc_id in (2000, 2001, 2002)]
    assert len(set(empty)) == 1 and empty[0] < 0.5


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs, marks = _texts()
    docs_df = spark.createDataFrame([(*d, "s", "t", 1, 2) for d in docs[:400]], DOCS)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, 1) for d, t in marks]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(docs_df, spark.createDataFrame(m, MARKS)).collect()) for m in ([(*m, 1) for m in marks], flipped))
    assert a == b


def test_toxicity_without_rows_or_labels(spark):
    docs_df, none = spark.createDataFrame([(1, "a b", "s", "t", 1, 2)], DOCS), spark.createDataFrame([], MARKS)
    assert [tuple(r) for r in toxicity(docs_df, none).collect()] == [(1, False, 0.0, 0)]
    only = spark.createDataFrame([(1, 1, 0)], MARKS)
    assert [r.predicted for r in toxicity(docs_df, only).collect()] == [1]
    assert toxicity(spark.createDataFrame([], DOCS), only).count() == 0


def test_windows_cover_every_word():
    texts = ["", "a", "one two three four five six seven  eight\n nine", "y" * 500, " lead", "a b c d e f"]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, folded = _folded(np.frombuffer(raw, np.uint8), off)
    start, end, text = _windows(data, folded)
    for i, t in enumerate(texts):
        whole = (" " + " ".join(t.split())) if t.split() else " "
        assert data[folded[i]:folded[i + 1]].tobytes().decode().rstrip() == whole.rstrip()
        covered = np.zeros(folded[i + 1] - folded[i], bool)
        for s, e in zip(start[text == i], end[text == i]):
            covered[s - folded[i]:e - folded[i]] = True
        assert covered.sum() >= len(whole.rstrip())
        assert ((end - start) <= 6 * 48 + 6).all()
