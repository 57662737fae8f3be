"""Quality rules with host verdicts.

Each document's rules are computed from its whole text. Rule failures are
summed by host; a host's rate is shrunk by a beta prior that is fitted to all
hosts (empirical Bayes), and the verdicts are joined back to the documents. A
document that fails one of SOFT_RULES itself goes, unless its host is clearly
better than the prior at that rule (there it counts as the odd one out); all
documents of a host go if its shrunk rate of any rule is above HOST_LIMIT."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, pieces, staged
from .spans import BYTES, SPACE, hash_ranges, lines, mix, owner, shingles, words

#: A host is rejected if a shrunk failure rate is above this.
HOST_LIMIT = 0.8
#: Rules whose failure a host's verdict may forgive, and how far below the prior's
#: mean its shrunk rate must lie for that.
SOFT_RULES = ("symbols", "dup_lines", "word_length")
HOST_BETTER = 0.9
#: The signs counted as symbols: # * $ % & | < >
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _in_text(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The hashes made distinct between texts."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def text_features(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The FEATURES of each text."""
    n = len(off) - 1
    start, end = words(data, off)
    doc = owner(off, start)
    n_words = np.bincount(doc, minlength=n)
    chars = _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), off)
    symbols = _per_text(SYMBOL[data], off)
    # lines with a word that equal an earlier line of the text
    line_doc, lo, hi = lines(data, off)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=inside[1:])
    full = inside[hi] > inside[lo]
    line_doc, lo, hi = line_doc[full], lo[full], hi[full]
    keys = _in_text(hash_ranges(data, lo, hi, BYTES), line_doc)
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    dup = np.bincount(line_doc[~first], minlength=n)
    n_lines = np.bincount(line_doc, minlength=n)
    # words in three-word windows that occur twice or more in the text
    window, at = shingles(hash_ranges(data, start, end, BYTES), doc, 3)
    _, inverse, count = np.unique(_in_text(window, doc[at]), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    covered = np.zeros(len(start), bool)
    for i in range(3):
        covered[twice + i] = True
    repeats = np.bincount(doc[covered], minlength=n)
    return [x.astype(np.int64) for x in (n_words, chars, symbols, dup, repeats, n_lines)]


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and FEATURES of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string())] + [(f, pa.int64()) for f in FEATURES])

    def compute(batches):
        for b in batches:
            for lo, hi, data, off in pieces(b.column("text")):
                yield batch(schema, b.column("doc_id")[lo:hi], b.column("host")[lo:hi].cast(pa.string()), *text_features(data, off))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(compute, "doc_id long, host string, " + ", ".join(f"{f} long" for f in FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules that hosts are judged by; true: the document fails."""
    w = F.col("n_words")
    return {
        "short": w < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * w,
        "symbols": 10 * F.col("n_symbols") > w,
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") > 12 * w) | (F.col("word_chars") < 2 * w),
    }


def beta_priors(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """alpha and beta of each rule by the method of moments for a beta-binomial:
    the mean is the overall rate, the strength comes from the spread between
    hosts. One aggregate over the hosts' sums gives all of them."""
    n = F.col("n").cast("double")
    t = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *[F.sum(r).alias(f"{r}_f") for r in names],
                  *[F.sum(F.col(r) / n * F.col(r)).alias(f"{r}_ff") for r in names]).first()
    if not t.n:
        return dict.fromkeys(names, (1.0, 1.0))
    out = {}
    for r in names:
        p = min(max(t[f"{r}_f"] / t.n, 1e-9), 1 - 1e-9)
        spread = max(t[f"{r}_ff"] - 2 * p * t[f"{r}_f"] + p * p * t.n, 0.0)
        room = t.n - t.nn / t.n - (t.k - 1)
        rho = (spread / (p * (1 - p)) - (t.k - 1)) / room if room > 0 else 0.5
        rho = min(max(rho, 1e-6), 0.999)
        out[r] = p * (1 / rho - 1), (1 - p) * (1 / rho - 1)
    return out


def host_verdicts(feats: DataFrame) -> DataFrame:
    """host, n, a shrunk rate per rule, host_ok, and per soft rule whether the
    host is clearly better than the prior; one row per non-null host."""
    checks = rules()
    hosts = staged(feats.where(F.col("host").isNotNull()).groupBy("host")
                   .agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in checks.items()]), "hosts")
    priors = beta_priors(hosts, list(checks))
    rate = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in priors.items()}
    better = [(rate[r] < HOST_BETTER * priors[r][0] / sum(priors[r])).alias(f"{r}_better") for r in SOFT_RULES]
    return hosts.select("host", "n", *[x.alias(f"{r}_rate") for r, x in rate.items()], (F.greatest(*rate.values()) <= HOST_LIMIT).alias("host_ok"), *better)


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The features, base_failed and kept of every row, host_rejected and
    own_failed (a soft rule that the host's verdict doesn't forgive).

    docs: doc_id, text and the host column (further columns are ignored). One
    row comes out per row. Null and empty texts have no words and fail; rows
    with a null host are judged by their own rules alone; repeated rows count
    as often as they come; an empty table gives an empty result."""
    feats = staged(features(docs, host), "quality-features")
    verdicts = staged(host_verdicts(feats).select("host", "host_ok", *[f"{r}_better" for r in SOFT_RULES]), "host-verdicts")
    checks = rules()
    own = F.lit(False)
    for r in SOFT_RULES:
        own = own | (checks[r] & ~F.coalesce(f"{r}_better", F.lit(False)))
    rejected = ~F.coalesce("host_ok", F.lit(True))
    return (feats.join(verdicts, "host", "left")
            .select("doc_id", *FEATURES[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected & ~own).alias("kept"),
                    rejected.alias("host_rejected"), own.alias("own_failed")))
