"""Each operator against a plain version on a small table with nulls, empty and
long texts, ties, repeated rows, an empty table and clashing column names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from acqspark.llm import op8_line_dedup as op8  # noqa: E402
from acqspark.llm.lexicon import Lexicon, build, save  # noqa: E402
from acqspark.llm.op1_language_id import SAMPLE_ROWS, language_id, suffix_automaton, training_sample  # noqa: E402
from acqspark.llm.op2_archive_conversion import archive_conversion  # noqa: E402
from acqspark.llm.op3_token_counts import fresh_cache, token_counts  # noqa: E402
from acqspark.llm.op4_quality_rules import quality_rules  # noqa: E402
from acqspark.llm.op5_token_files import token_files  # noqa: E402
from acqspark.llm.op6_minhash import near_duplicates  # noqa: E402
from acqspark.llm.op7_bpe_lexicon import bpe_codec  # noqa: E402
from acqspark.llm.op9_hilbert_sharding import hilbert_index, hilbert_shards  # noqa: E402
from acqspark.llm.op10_decontamination import contaminated  # noqa: E402
from acqspark.llm.spanmemo import load_tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_tokens string, set_id string, host string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def _texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = prose(200)
    near = base.split(" ")
    near[100] = "changed"
    passage = prose(60)
    out = [base, base, " ".join(near), None, "", " \n\t ", "Hi", "hi", "!!! 12 ...", prose(120) + "\n" + passage + "\n" + prose(30),
           prose(90) + "\n" + passage, passage + "\n" + passage + "\n" + prose(40), "a b c " * 100, "x" * 5000, prose(20_000),
           "it's <|endoftext|> don't <|startoftext|>x ΣΑΣ İ a b é 日本 \x1c", "  lead\n\n\ntrail \xa0 "]
    return out + [prose(r.randint(3, 80)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}" if i % 7 else None), 1, 9, "x", "y", "z", 3) for i, t in enumerate(_texts())]
    rows.append(rows[2])  # a repeated row
    rows.append((None, "no id here at all", "en", "s1", 1, 9, "x", "y", "z", 3))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def _same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_language_id(docs, empty):
    out = language_id(docs).collect()
    assert len(out) == docs.count()
    text = dict(_rows(docs))
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id]))
    assert language_id(empty).count() == 0


def test_phrase_counts_equal_a_naive_parse():
    from acqspark.llm.op1_language_id import CrossParser

    r = random.Random(4)
    make = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n))
    han = [chr(0x4E00 + i) for i in range(3000)]
    sample = [("a", make("abcde", 40)) for _ in range(30)] + [("b", make("cdefgé", 40)) for _ in range(30)] + [("c", make(han, 40)) for _ in range(120)]
    parser = CrossParser(sample)
    learned = {x: " ".join(" ".join(t.split()) for y, t in sample if y == x) for x in "abc"}
    texts = ["", "  ", "a", "Abc de, CDE!", "xyz", make("abcdefg", 3000), make("abcde", 200), sample[3][1] * 30, make(han, 700) + " abc", "e" * 1000, "zq" * 700]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    phrases, _, _ = parser.parse(np.frombuffer(b"".join(raw), np.uint8), off)
    for k, lang in enumerate("abc"):
        for i, t in enumerate(texts):
            s = "".join(c.lower() if c.isalpha() else " " for c in t)
            s = re.sub(" +", " ", s).lstrip(" ")
            n = at = 0
            while at < len(s):
                to = at + 1
                while to < len(s) and s[at:to + 1] in learned[lang]:
                    to += 1
                n, at = n + 1, to
            assert phrases[k, i] == n, (lang, i)
    import pickle
    assert len(pickle.dumps(parser)) < 20 << 20


def test_language_is_found_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect() if r.text and len(r.text) > 40}
    got = [(r.lang_pred, want[r.doc_id]) for r in language_id(docs).collect() if r.held_out and want.get(r.doc_id)]
    assert len(got) > 100 and np.mean([a == b for a, b in got]) >= 0.99


def test_equal_languages_go_by_name_and_too_many_are_an_error(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"same words here {i // 2}", "ab"[i % 2]) for i in range(40)]
    assert {r.lang_pred for r in language_id(spark.createDataFrame(rows, schema)).collect()} == {"a"}
    with pytest.raises(ValueError):
        language_id(spark.createDataFrame([(i, f"word {chr(97 + i % 26)}", f"l{i}") for i in range(600)], schema)).collect()


def test_training_sample_takes_copies_once_and_no_order_of_text(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) + " more words" for _ in range(600)]
    texts += ["aaa the same start " * 30 + str(i) for i in range(300)]  # these begin alike and sort first
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    sample = [t for _, t in training_sample(docs)]
    assert len(sample) == len(set(sample)) == SAMPLE_ROWS and sum(t.startswith("aaa the") for t in sample) <= 1  # their windows are equal
    assert sample != sorted(sample) and sum(t < "n" for t in sample[:60]) < 50
    assert sample == [t for _, t in training_sample(docs.repartition(5).unionByName(docs))]


def test_suffix_automaton_holds_all_substrings():
    arcs, _, _ = suffix_automaton("abcbcab")
    def known(s):
        state = 0
        for c in s:
            if c not in arcs[state]:
                return False
            state = arcs[state][c]
        return True
    assert all(known("abcbcab"[i:j]) for i in range(7) for j in range(i, 8)) and not known("cc")


def test_archives(spark, empty):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 10, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x.org/{i} ü", h, 7) for i, h in enumerate(html)] + [(None, None, "lone", 7)], "page_id long, url string, html string, nth int")
    last = {}
    for i, h in [*enumerate(html), (None, "lone")]:
        last[h or ""] = i
    want = []
    for i, h in [*enumerate(html), (None, "lone")]:
        b = (h or "").encode()
        won = last[h or ""] == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if won else "revisit", None if won else last[h or ""]))
    _same(archive_conversion(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    assert archive_conversion(pages.limit(0)).count() == 0


def test_foreign_arc_files(spark, tmp_path):
    import gzip

    from acqspark.llm.op2_archive_conversion import convert, index_arcs, read_warcs, revisits, warc_date

    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    records = [("http://a.org/", "20010203040506", "text/html", http + b"<p>a</p>"), ("dns:a.org", "200102030405", "text/dns", b"1.2.3.4"),
               ("http://b.org/", "2001", "text/html", http), ("http://c.org/", "notadate", "text/html", http + b"<p>a</p>"), ("ftp://d.org/", "20011399000000", "no-type", b"")]

    def one(line, fields, body):
        return f"{line} {len(body)}\n".encode() + body + b"\n"

    v1 = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    made = one("filedesc://x.arc 0.0.0.0 20010101000000 text/plain", 5, v1)
    made += b"".join(one(f"{u} 9.9.9.9 {d} {k}", 5, b) for u, d, k, b in records)
    v2 = b"2 0 test\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    second = one("filedesc://y.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 y.arc", 10, v2)
    second += b"".join(one(f"{u} 9.9.9.9 {d} {k} 200 - - 0 y.arc", 10, b) for u, d, k, b in records[:1])
    for name, raw in (("x", made), ("y", second)):
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(raw))
    arcs = spark.createDataFrame([(f"file://{tmp_path}/{n}.arc.gz",) for n in "xy"], "path string")
    got = read_warcs(convert(revisits(index_arcs(arcs)), f"file://{tmp_path}/warc")).collect()
    by = Counter((r.url, r.record_type, r.payload_bytes) for r in got)
    assert by["dns:a.org", "resource", 7] == by["ftp://d.org/", "resource", 0] + by["ftp://d.org/", "revisit", 0] == 1 and len(got) == 6
    assert sum(r.record_type == "revisit" for r in got) == 3  # <p>a</p> three times, nothing twice
    assert [warc_date(d) for d in ("20010203040506", "200102030405", "2001", "notadate", "20011399000000")] == [
        "2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "2001-01-01T00:00:00Z"]


def test_one_document_is_read_from_a_stored_folder(spark, docs, tmp_path):
    from acqspark.llm.op5_token_files import document_ids, write_token_files

    folder = f"file://{tmp_path}/ids"
    write_token_files(docs, WORD_BPE, folder, 1)
    tok = load_tokenizer(WORD_BPE)
    texts = {}
    for i, t in _rows(docs):
        texts.setdefault(i, []).append(tok.encode(t, add_special_tokens=False).ids + [1])
    for i in (0, 2, 3, 14, 20):  # 2 stands in two rows, 3 is null, 14 is long
        assert [x.tolist() for x in document_ids(spark.newSession(), folder, i)] == texts[i]
    assert document_ids(spark, folder, 10_000) == []
    stored = next((tmp_path / "ids").glob("*.zdict"))
    stored.write_bytes(stored.read_bytes() + b"x")
    with pytest.raises(ValueError):
        document_ids(spark, folder, 0)
    stored.unlink()
    with pytest.raises(FileNotFoundError):
        document_ids(spark, folder, 0)


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicate", "decontaminate"])
def test_stages_on_clashing_columns(spark, tmp_path, stage):
    import corpus_pipeline

    names = ["_id", "_gone", "_gone_id", "_gone_mark", "lines_before", "kept", "host", "_ID_"]
    rows, items = _planted()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = run(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    more = spark.createDataFrame([(*r, *range(8)) for r in rows], schema + "".join(f", {n} long" for n in names))
    got = run(spark, more, str(tmp_path))
    assert got.columns == more.columns
    _same(got.select(plain.columns).collect(), plain.collect())
    assert {tuple(r) for r in got.select(names).distinct().collect()} == {tuple(range(8))}


def test_token_counts(spark, docs, empty):
    tok, cache = load_tokenizer(BYTE_BPE), fresh_cache(spark)
    want = []
    for i, t in _rows(docs):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 1024))
    _same(token_counts(docs, BYTE_BPE, cache).collect(), want)
    before = spark.read.parquet(cache).count()
    _same(token_counts(docs, BYTE_BPE, cache).collect(), want)
    assert before == spark.read.parquet(cache).count() == len({t for _, t in _rows(docs)})
    assert token_counts(empty, BYTE_BPE, fresh_cache(spark)).count() == 0


def test_quality(docs, empty):
    want = []
    for i, t in _rows(docs):
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), failed))
    out = quality_rules(docs)
    _same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
    assert all(r.kept == (not r.base_failed and not r.host_rejected and not r.own_failed) for r in out.collect())
    assert quality_rules(empty).count() == 0


def test_host_verdicts_decide_on_junk(spark):
    r = random.Random(3)
    words = lambda n, join=" ": join.join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, junk = [], set()
    for h in range(20):  # ordinary hosts: every fifth text is junk; a bad one: all; a good one: one in 300
        for k in range(40):
            rows.append((len(rows), words(80, " ### " if k % 5 == 0 else " "), f"h{h}"))
            junk |= {rows[-1][0]} if k % 5 == 0 else set()
    bad = [(len(rows) + k, words(80, " ### " if k < 59 else " "), "bad") for k in range(60)]
    good = [(5000 + k, words(80, " ### " if k == 7 else " "), "good") for k in range(300)]
    nowhere = [(9000, words(80, " ### "), None), (9001, words(80), None)]
    out = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows + bad + good + nowhere, "doc_id long, text string, source string")).collect()}
    for i, _, host in rows:
        assert out[i].kept == (i not in junk)  # an ordinary host forgives nothing
    assert not any(out[i].kept for i, *_ in bad) and all(out[i].host_rejected for i, *_ in bad)  # the clean text too
    assert all(out[i].kept for i, *_ in good)  # the odd one out is forgiven
    assert not out[9000].kept and out[9001].kept


def test_verdicts_act_on_the_given_documents(spark):
    out = {x.doc_id: x for x in quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    assert all(not out[i].kept and not out[i].base_failed for i in (32, 39, 40))  # words joined by ###, $$$ or |
    clean = {x.doc_id for x in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").collect()}
    assert all(out[i].kept for i in clean if not out[i].base_failed)


def test_token_files(docs, empty):
    tok = load_tokenizer(WORD_BPE)
    out = token_files(docs, WORD_BPE).orderBy("start").collect()
    ids = {(i, t): tok.encode(t, add_special_tokens=False).ids + [1] for i, t in _rows(docs)}
    assert [r.doc_id for r in out] == sorted((i for i, _ in _rows(docs)), key=lambda i: (i is not None, i))
    assert [r.start for r in out] == (np.cumsum([r.n_tokens for r in out]) - [r.n_tokens for r in out]).tolist()
    _same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], [(i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t in _rows(docs)])
    assert token_files(empty, WORD_BPE).count() == 0


def _near(rows, n):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    return [(rows[k][0], len(sets[k]), least[group[k]], rows[k][0] == least[group[k]]) for k in range(len(rows))]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    _same(near_duplicates(docs, n).collect(), _near(_rows(docs), n))


def test_near_duplicates_chain_and_dense_group(spark, empty):
    r = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # edits of one text, some beyond the limit of each other
        w = list(base)
        for k in r.sample(range(120), r.randint(0, 5)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    _same(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), _near(rows, 4))
    assert near_duplicates(empty).count() == 0


def test_bpe(docs, empty):
    tok = load_tokenizer(WORD_BPE)
    want = []
    for i, t in _rows(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    _same(bpe_codec(docs, WORD_BPE).collect(), want)
    assert bpe_codec(empty, WORD_BPE).count() == 0


def test_lexicon(tmp_path):
    words = sorted({w.encode() for w in "tops top taps tap stops stop é éa a".split()})
    lex = Lexicon(save(str(tmp_path), build([(w, list(w)) for w in words])))
    assert lex.ranks(words + [b"to", b"", b"topsy"]).tolist() == [*range(len(words)), -1, -1, -1]
    ids, n = lex.take(np.arange(len(words)))
    assert bytes(ids.tolist()) == b"".join(words) and n.tolist() == [len(w) for w in words]


def test_line_dedup(docs, empty):
    rows = {(r.doc_id, r.before): r for r in op8.line_dedup(docs.withColumnRenamed("n_tokens", "before").withColumn("before", docs["text"])).collect()}
    held = {}
    for i, t in sorted((r for r in _rows(docs) if r[0] is not None), key=lambda r: r[0]):
        r = rows[i, t] if (i, t) in rows else rows[i, None]
        lines = t.split("\n")
        kept = (r.text or "").split("\n")
        gone = Counter(lines) - Counter(kept)
        assert sum(gone.values()) == r.lines_deleted or r.text == ""
        for x in lines:  # long lines that an earlier text holds are gone, others stay
            if len(x.split()) >= 10:
                assert (x in kept) == (held.get(x.strip(), i) == i)
        for x in lines:
            held.setdefault(x.strip(), i)
    assert op8.line_dedup(empty).count() == 0


def test_line_dedup_finds_the_holder_of_a_block_of_short_lines(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    texts = [[a, b], [b, c], [a, b, c], [a, b, c]]
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in op8.line_dedup(rows).collect()} == {0: f"{a}\n{b}", 1: f"{b}\n{c}", 2: f"{a}\n{b}\n{c}", 3: ""}


def test_patience():
    assert op8.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert op8.patience([1, 1, 2], [2, 1, 1]) in ([(0, 1), (1, 2)], [(2, 0)])
    assert op8.deleted_lines(([0, 1, 2], [7, 8, 9]), ([0, 1, 2], [9, 7, 8], [6, 6, 6]), 10) == [1, 2]


def _blocks(a, d, least):
    """Places of d in blocks of least words that stand in a; both are lists of lines."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(d)):
            n = 0
            while i + n < len(a) and j + n < len(d) and a[i + n] == d[j + n]:
                n += 1
            if sum(len(x.split()) for x in d[j:j + n]) >= least:
                gone |= set(range(j, j + n))
    return gone


def test_deleted_lines_tries_short_blocks_again():
    s = [7, 8, 9]
    assert sorted(op8.deleted_lines((list(range(5)), [s[0], 5, *s]), ([0, 1, 2], s, [4, 4, 4]), 10)) == [0, 1, 2]
    r = random.Random(3)
    for _ in range(300):
        a, d = ([r.choice("abcdefg") for _ in range(r.randint(0, 14))] for _ in range(2))
        line = {x: " ".join(x * (1 + ord(x) % 4)) for x in "abcdefg"}
        got = op8.deleted_lines((list(range(len(a))), [ord(x) for x in a]), (list(range(len(d))), [ord(x) for x in d], [len(line[x].split()) for x in d]), 10)
        assert len(got) == len(set(got)) and set(got) == _blocks([line[x] for x in a], [line[x] for x in d], 10)


def test_line_dedup_of_short_lines(spark):
    r = random.Random(4)
    line = [" ".join(f"{x}{k}" for k in range(1 + i % 5)) for i, x in enumerate("abcdefghij")]
    texts = [[r.choice(line) for _ in range(r.randint(0, 25))] for _ in range(60)]
    rows = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in op8.line_dedup(rows).collect()}
    some = 0
    for i, t in enumerate(texts):
        gone = set().union(*(_blocks(texts[k], t, 10) for k in range(i)))
        some += len(gone)
        assert got[i].text == "\n".join(x for j, x in enumerate(t) if j not in gone) and got[i].lines_deleted == len(gone)
    assert some > 50


def test_shards(docs, empty, spark):
    out = hilbert_shards(docs).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == docs.count() and max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in sizes)
    _same([(r.doc_id, r.size, r.text_crc32) for r in out], [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in _rows(docs)])
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in out)
    assert hilbert_shards(empty).count() == 0


def test_hilbert_neighbours(spark):
    import itertools

    from pyspark.sql import functions as F

    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "a int, b int, c int")
    rows = sorted(cells.select("a", "b", "c", hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3).alias("h")).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(rows, rows[1:]))


def test_hilbert_groups_pruning_and_files(spark, tmp_path):
    from acqspark.llm.op9_hilbert_sharding import BITS, category_bins, write_shards

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hilbert_shards(docs)
    rows = {r.doc_id: r for r in out.collect()}
    meta = {r.doc_id: r for r in docs.collect()}
    groups = {}
    for i, m in meta.items():
        groups.setdefault(m.text or "", []).append(rows[i])
    firsts = {s: min(r.curve for r in rows.values() if r.shard == s) for s in range(16)}
    for same in groups.values():
        assert len({r.curve for r in same}) == 1
        spread = {r.shard for r in same}  # in two shards only where a cut runs through the group
        assert max(spread) - min(spread) == len(spread) - 1 and all(firsts[s] == same[0].curve for s in sorted(spread)[1:])
    # a plain version of the cells
    order = sorted({m.source for m in meta.values() if m.source is not None})
    bins = {r.source: r.b for r in docs.select("source", category_bins(docs, "source").alias("b")).distinct().collect()}
    assert [bins[x] for x in order] == [k * (1 << BITS) // len(order) for k in range(len(order))] and len(set(bins.values())) == len(order)
    # shards that a reader of one source and one half of the sizes has to open
    half = sorted(r.size for r in rows.values())[len(rows) // 2]
    opened = [len({rows[i].shard for i, m in meta.items() if m.source == x and (rows[i].size > half) == big}) for x in order for big in (False, True)]
    assert np.mean(opened) < 8
    write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows.values())
    assert len(list((tmp_path / "s").glob("shard=*"))) == 16


def test_contaminated(spark, docs, empty):
    texts = dict(_rows(docs))
    whole = WORD.findall(texts[9])
    items = [(1, " ".join(whole[20:60])), (2, "hi"), (3, None), (4, ""), (5, " ".join(whole[70:90]).upper()), (1, " ".join(whole[20:60]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    fold = lambda t: WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
    want = set()
    for i, t in _rows(docs):
        w = fold(t)
        for k, x in items:
            v = fold(x or "")
            n = min(5, len(v))
            if not n or (n < 5 and len(w) != n):
                continue
            b = Counter(tuple(v[j:j + n]) for j in range(len(v) - n + 1))
            s = [tuple(w[j:j + n]) for j in range(len(w) - n + 1)]
            width = min(b.total(), len(s))
            best = max(((a & b).total() / (a | b).total() for j in range(len(s) - width + 1) if (a := Counter(s[j:j + width]))), default=0)
            if best >= 0.8:
                want.add((i, k, best))
    assert len(want) >= 3
    assert {(r.doc_id, r.item_id, r.similarity) for r in contaminated(docs, bench).collect()} == want
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_by_short_items(spark):
    texts = ["a b c d e f g h", "x A  b\nc", "a b x c", "b c", "c", "", "d e f g h i j k a b"]
    items = ["b C", "a b c", "d e f g", "d e f g h", "k", "z", "a b c d e f"]
    want = set()
    for i, t in enumerate(texts):
        w = t.lower().split()
        for k, x in enumerate(items):
            v = x.lower().split()
            at = [j for j in range(len(w) - len(v) + 1) if w[j:j + len(v)] == v]
            want |= {(i, k, 1.0, j, len(v)) for j in at[:1]}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(want) == 11 and set(map(tuple, contaminated(docs, bench).collect())) == want


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = [(r.doc_id, r.text) for r in out.collect()]
        before = _rows(docs)
        if name == "near_duplicate":
            assert {i for i, _ in rows} == {i for i, _, _, kept in _near(before, 5) if kept}
        elif name == "quality":
            failed = {r.doc_id for r in quality_rules(docs).collect() if not r.kept}
            assert {i for i, _ in rows} == {i for i, _ in before} - failed
        else:
            assert {i for i, _ in rows} <= {i for i, _ in before}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def _planted():
    """(doc_id, text, lang, source, n_chars) with something for each stage, and benchmark items."""
    r = random.Random(7)
    prose = lambda n: [r.choice("bdfgklmnprst") + "".join(r.choice("aeiou") + r.choice("bdfgklmnprst") for _ in range(3)) for _ in range(n)]
    page = lambda *more: "\n".join([" ".join(prose(9)) for _ in range(6)] + list(more))
    a, b, c, x, s1, s2, s3 = (" ".join(prose(4)) for _ in range(7))
    long, passage = " ".join(prose(12)), prose(60)
    changed = [*passage[:30], "changed", *passage[31:]]
    junk = lambda: "\n".join(" ### ".join(prose(10)) for _ in range(6))
    first = page(long)
    good = [first, page(a, b), page(b, c), page(a, b, c), page(long, "", a, " " + b + " ", c), first, page(s1, x, s1, s2, s3), page(s1, s2, s3), page(a, c, b)]
    good += [" ".join(first.split()), page(" ".join(passage)), page(" ".join(changed)), page("see Short  item", "here"), page("short", "item here"), page("item short here")]
    good += [page() for _ in range(15)] + [junk(), " ".join(prose(20)), "a b c " * 100, None]
    rows = [(i, t, f"g{i % 3}") for i, t in enumerate(good)] + [(100 + i, junk(), "bad") for i in range(20)]
    rows += [(200, junk(), None), (None, page(), "g1"), (201, page(), "bad"), rows[1], rows[12], (202, page(), "g2"), (202, "too short", "g2")]
    return [(i, t, "en", h, len(t or "")) for i, t, h in rows], [(1, " ".join(passage)), (2, "Short item HERE"), (3, " ".join(prose(40))), (4, None), (5, "")]


def _kept_by_quality(rows):
    """Ids whose rows pass their own rules and those of their hosts."""
    fails = []
    for i, t, _, host, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        fails.append((i, host, [len(w) < 50, 100 * len(covered) > 50 * len(w), 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w),
                                2 * (len(full) - len(set(full))) > len(full), chars > 12 * len(w) or chars < 2 * len(w)]))
    n = Counter(h for _, h, _ in fails if h is not None)
    total, room = sum(n.values()), sum(n.values()) - sum(v * v for v in n.values()) / sum(n.values()) - (len(n) - 1)
    rejected, better = set(), set()
    for rule in range(5):
        x = Counter(h for _, h, f in fails if h is not None and f[rule])
        p = min(max(sum(x.values()) / total, 1e-9), 1 - 1e-9)
        rho = (sum(n[h] * (x[h] / n[h] - p) ** 2 for h in n) / (p * (1 - p)) - (len(n) - 1)) / room
        rho = min(max(rho, 1e-6), 0.999)
        rate = {h: (x[h] + p * (1 / rho - 1)) / (n[h] + 1 / rho - 1) for h in n}
        rejected |= {h for h in n if rate[h] > 0.8}
        better |= {(h, rule) for h in n if rate[h] < 0.9 * p}
    bad = {i for i, h, f in fails if f[0] or f[1] or h in rejected or any(f[k] and (h, k) not in better for k in (2, 3, 4))}
    return {i for i, _, _ in fails} - bad, rejected


def _cleaned(rows):
    """The rows without the line blocks of 10 words that an earlier document holds."""
    full = lambda t: [(k, x.strip(" \t\r\v\f")) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
    out = []
    for i, t, lang, host, n in rows:
        mine = full(t)
        gone = set()
        for t2 in {t2 for i2, t2, *_ in rows if i is not None and i2 is not None and i2 < i}:
            gone |= {mine[j][0] for j in _blocks([x for _, x in full(t2)], [x for _, x in mine], 10)}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or WORD.search(left):
            out.append((i, left, lang, host, len(left) if gone else n))
    return out


def _holds(text, item):
    w, v = (WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) for t in (text, item))
    n = min(5, len(v))
    if not n:
        return False
    b = Counter(tuple(v[j:j + n]) for j in range(len(v) - n + 1))
    s = [tuple(w[j:j + n]) for j in range(len(w) - n + 1)]
    width = min(b.total(), len(s))
    return any((a & b).total() >= 0.8 * (a | b).total() for j in range(len(s) - width + 1) if (a := Counter(s[j:j + width])))


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicate", "decontaminate", "encode"]
    rows, items = _planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def check(name, want):
        got = [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, schema).repartition(3), str(tmp_path)).collect()]
        _same(got, want)
        return want

    kept, rejected = _kept_by_quality(rows)
    assert rejected == {"bad"} and {30, None} <= kept and not {31, 32, 33, 200, 201, 202} & kept
    rows = check("quality", [r for r in rows if r[0] in kept])
    want = _cleaned(rows)
    gone = Counter()
    for table, sign in ((rows, 1), (want, -1)):
        for i, t, *_ in table:
            gone[i] += sign * len(t.split("\n"))
    assert {i: n for i, n in gone.items() if n} == {4: 4, 5: 7, 7: 3} and len(want) == len(rows) - 1
    rows = check("lines", want)
    near = {i for i, _, _, ok in _near([r[:2] for r in rows], 5) if not ok and i is not None}
    assert near == {9}
    rows = check("near_duplicate", [r for r in rows if r[0] not in near])
    held = {r[0] for r in rows for _, x in items if _holds(r[1], x)}
    assert held == {10, 11, 12, 13}
    rows = check("decontaminate", [r for r in rows if r[0] not in held])
    tok, want = load_tokenizer(WORD_BPE), []
    for i, t, *_ in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    check("encode", want)
