"""Substring dedup of texts that repeat a word or a few words many times: each repeat has a window of the same value."""

import random

import numpy as np
import pyarrow as pa
import pytest

from octaspark.llm import substring_dedup
from octaspark.llm.words import mix


@pytest.mark.parametrize("period", [1, 2, 7])
def test_few_windows_hold_all_passages(period):
    rnd = np.random.default_rng(period)
    own = lambda n: rnd.integers(1, 2**63, n, dtype=np.uint64)
    sh = np.concatenate([own(80), np.resize(own(period), 2000), own(70), np.resize(own(period), 50), own(60)])
    first, width = np.array([0, 130, len(sh)]), 46  # the second text begins inside the run
    h = mix(sh)
    every = substring_dedup.compact_windows(h, first, width)
    c, left, right = substring_dedup._thin(sh, h, first, *every)
    assert set(c) <= set(every[0]) and (left <= c).all() and (c <= right).all()
    for lo in range(len(sh) - width + 1):  # the least place of each passage is in a window of its value around the passage
        if not lo < 130 < lo + width:
            least = h[lo : lo + width].min()
            assert ((h[c] == least) & (left <= lo) & (right >= lo + width - 1) & (lo <= c) & (c < lo + width)).any()
    for k in range(len(c)):  # and it is the least of its window
        assert h[left[k] : right[k] + 1].min() == h[c[k]]


def test_windows_of_one_word():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the " * 3000, "one two " * 1500])], names=["doc_id", "text"])
    found = pa.Table.from_batches(substring_dedup._windows(5, 46, 3)([batch]))
    assert found.num_rows < 3 * 2 * (3000 // substring_dedup.DRIFT + 60)  # 17,000 with one for each place


def test_all_of_a_run_is_found(spark):
    """Runs of different lengths with the same text before or after, and of one word alone."""
    rnd = random.Random(15)
    own = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    rows, want = [], []

    def add(one, two, at, n):
        want.append((len(rows) + 1, at, n))
        for x in (one, two):
            rows.append((len(rows), " ".join(x)))

    for k in range(30):
        w, v, p, q = own(1), own(2), own(30), own(20)
        m, n = rnd.randrange(25, 60), rnd.randrange(60, 150)
        add(own(20) + w * m + p + own(20), own(30) + w * n + p + own(9), 30 + n - m, m + 30)  # goes on after
        w = own(1)
        add(own(20) + p[::-1] + w * m + own(20), own(30) + p[::-1] + w * n + own(9), 30, 30 + m)  # begins before
        w = own(1)
        add(own(20) + w * 70 + own(20), own(7) + w * 400 + own(9), 7, 400)  # each passage of the longer one is one of the shorter one
        add(own(20) + q + v * 30 + own(20), own(7) + q + v * 40 + own(9), 7, 80)
    by = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        by.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    got = [len(by.get(d, set()) & set(range(at, at + n))) / n for d, at, n in want]
    assert min(got) == 1, sorted((g, k % 4) for k, g in enumerate(got))[:20]
