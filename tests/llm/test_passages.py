"""Recall of repeated passages: hubs that hold pieces of them, near repeats, hot values, odd rows."""

import random

import pytest

from octaspark.llm import substring_dedup

PIECES = {
    "none": [], "thirds": [(0, 20), (20, 40), (40, 60)], "sixths": [(k, k + 10) for k in range(0, 60, 10)], "long": [(0, 49), (11, 60)],
    "overlapping": [(0, 40), (10, 50), (20, 60)], "turned": [(30, 60), (0, 30)],
}


def corpus(edit, n=40):
    """Pairs of documents that share 60 words; the first also holds pieces of them before."""
    rnd = random.Random(3)
    prose = lambda k: [f"w{rnd.randrange(50_000)}" for _ in range(k)]
    rows, pairs = [], []
    for spec in PIECES.values():
        for _ in range(n):
            p = prose(60)
            one = prose(20)
            for a, b in spec:
                one += prose(rnd.randrange(8, 30)) + p[a:b]
            one += prose(30) + p + prose(rnd.randrange(5, 60))
            two = prose(rnd.randrange(5, 60))
            pairs.append((len(rows), len(rows) + 1, len(two)))
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two + edit(rnd, p) + prose(rnd.randrange(5, 60))))]
    return rows, pairs


@pytest.mark.parametrize("hot", [False, True])
def test_exact_passages_are_all_found(spark, monkeypatch, hot):
    if hot:  # every repeated value counts as a hot one
        monkeypatch.setattr(substring_dedup, "HOT", 2)
        monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    rows, pairs = corpus(lambda rnd, p: p)
    by = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by.setdefault(r.doc_id, []).append(r)
    for a, b, at in pairs:
        assert any(r.source_id == a and r.start <= at + 5 and r.start + r.n_words >= at + 55 for r in by[b])


def test_near_passages(spark):
    """One word of sixty changed in the middle: five shingles of 56 differ, a similarity of 0.84."""
    rows, pairs = corpus(lambda rnd, p: p[: (k := rnd.randrange(10, 50))] + ["changed"] + p[k + 1 :], n=50)
    cls = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        cls.setdefault(r.doc_id, set()).add(r.class_id)
    found = sum(bool(cls.get(a, set()) & cls.get(b, set())) for a, b, _ in pairs)
    assert found >= 0.97 * len(pairs)


def test_odd_rows(spark):
    p = " ".join(f"w{k}" for k in range(70))
    rows = [(None, p, 1), (1, p, 1), (1, p, 1), (2, p, 1), (3, None, 1), (4, "", 1), (5, "few words", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "2 AS doc", "3 AS hub", "4 AS shingles")
    got = substring_dedup.find(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.class_id for r in got} == {1}
    assert substring_dedup.find(df.limit(0)).count() == 0


def test_near_passages_behind_a_partial_hub(spark):
    """The least document holds a part of a passage only; two later ones hold nearly the same whole."""
    rnd = random.Random(9)
    prose = lambda k: [f"w{rnd.randrange(50_000)}" for _ in range(k)]
    rows, pairs = [], []
    for a, b in ((0, 30), (15, 45), (0, 45), (20, 60), (5, 55)):
        for _ in range(30):
            p, k = prose(60), rnd.randrange(10, 50)
            pairs.append(len(rows) + 1)
            for own in (p[a:b], p, [*p[:k], "changed", *p[k + 1 :]]):
                rows.append((len(rows), " ".join(prose(25) + own + prose(35))))
    cls = {}
    for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        cls.setdefault(r.doc_id, set()).add(r.class_id)
    assert sum(bool(cls.get(i, set()) & cls.get(i + 1, set())) for i in pairs) >= 0.97 * len(pairs)
