"""The parity sketch never rules out a similar pair."""

import numpy as np

from acqspark.llm.op6_minhash import PARITY_WORDS, parities


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(5)
    for n, changed in ((1, 1), (40, 3), (400, 90), (5000, 1200)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
        sketch = parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        bits = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_empty_sets_and_block_edges():
    counts = np.tile([0, 2, 1], 1500)
    values = np.arange(counts.sum(), dtype=np.uint64)
    sketch = parities(values, counts)
    assert sketch.shape == (4500, PARITY_WORDS) and not sketch[::3].any()
    assert sketch[2::3].any(axis=1).all()
    alone = parities(values[-1:], np.array([1]))
    assert (sketch[-1] == alone[0]).all()
    assert parities(values[:0], np.zeros(0, np.int64)).shape == (0, PARITY_WORDS)
