"""Near repeats that only third documents share: the least ones of their values hold a part of them."""

import random

import numpy as np
import pytest

from octaspark.llm import substring_dedup
from octaspark.llm.ngram_join import common


@pytest.mark.parametrize("group", [1024, 2])
def test_near_repeats_of_third_documents(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rnd = random.Random(12)
    own = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for case in range(50):
        p, k = own(60), rnd.randrange(20, 40)
        one, two = p, [*p[:k], "changed", *p[k + 1 :]]
        if case % 2:  # a word more instead of another one
            two = [*p[:k], "more", *p[k:]]
        part = p[8:53] if k % 2 else p[6:51]
        pairs.append(len(rows) + 3)
        for body in (part, part, part, one, two):  # no two of the parts are 50 words long
            rows.append((len(rows), " ".join(own(30) + body + own(30))))
    cls = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        cls.setdefault(r.doc_id, set()).add(r.class_id)
    assert sum(bool(cls.get(i, set()) & cls.get(i + 1, set())) for i in pairs) >= 0.97 * len(pairs)


def test_a_repeat_of_a_repeat(spark):
    """The hub is near the second document, which is near the third; the third isn't near the hub."""
    rnd = random.Random(13)
    own = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(50):
        p = own(56)
        one, two = [*p[:12], "changed", *p[13:]], [*p[:44], "other", *p[45:]]
        pairs.append(len(rows) + 1)
        for body in (one, p, two):
            rows.append((len(rows), " ".join(own(30) + body + own(30))))
    got = {(r.source_id, r.doc_id) for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((i, i + 1) in got for i in pairs) >= 0.97 * len(pairs)


def test_common_values():
    """Values of few and of many sets, each once or several times, in one block and in two."""
    rnd = random.Random(14)
    sets = [np.array([rnd.randrange(40 if k % 2 else 4000) for _ in range(60)], np.uint16) for k in range(70)]
    for repeats, own in ((True, sets), (False, [np.unique(s) for s in sets])):
        want = np.array([[np.isin(a, b).sum() for b in own] for a in own])
        got = common(own, None, repeats)
        np.fill_diagonal(got, 0)
        np.fill_diagonal(want, 0)
        assert (got == want).all()
        assert (common(own[:30], own[30:], repeats) == want[:30, 30:]).all()
