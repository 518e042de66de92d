"""What spares the near-duplicate join work and disk, and must lose nothing."""

from __future__ import annotations

import numpy as np

from rastertables.llm import common, ngram_join


def _judged(x, y, similarity=0.8):
    rows = [np.frombuffer(ngram_join._counts(s), np.uint16)[None, :] for s in (x, y)]
    return bool(ngram_join._may_be_similar(np.array([len(x)]), np.array([len(y)]), *rows, similarity)[0])


def test_counts_rule_out_no_similar_sets():
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for n in (1, 2, 9, 50, 700, 5000, 200_000):
        both = draw(n)
        for own in (0, n // 20, n // 9, n // 8, n // 4):
            x, y = np.union1d(both, draw(own)), np.union1d(both, draw(own))
            shared = len(np.intersect1d(x, y))
            if shared >= 0.8 * (len(x) + len(y) - shared):
                assert _judged(x, y)
    assert not _judged(draw(700), draw(700)) and not _judged(draw(700), draw(900))
    narrow = np.arange(100_000, dtype=np.uint64)  # one range holds more than is told
    assert _judged(narrow, narrow[:90_000]) and not _judged(narrow, narrow[:70_000])


def test_tables_between_steps_are_zstd(spark):
    df = common.stored(spark.range(5), "small")
    assert all(".zstd." in f for f in df.inputFiles())
