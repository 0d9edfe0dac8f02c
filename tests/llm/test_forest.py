"""The forest of the n-gram join: labels, shortening, recall and blocks."""

import random

import numpy as np

from octaspark.llm import ngram_join


def jaccard_pair(rnd, n, changed):
    a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    b = list(a)
    for k in rnd.sample(range(0, n, 5), changed):
        b[k] = f"x{rnd.randrange(10**6)}"
    return a, b


def sets(w):
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_labels_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(4)
    both, one, two = (rnd.integers(0, 2**64, k, dtype=np.uint64) for k in (800, 100, 100))
    a, b = np.r_[both, one], np.r_[both, two]
    got = ngram_join.labels(np.r_[a, b], np.array([0, 900, 1800]), 48, 4)
    same = [(int(x >> (16 * s)) & 65535) == (int(y >> (16 * s)) & 65535) for x, y in zip(got[0], got[1]) for s in range(4)]
    assert abs(np.mean(same) - 0.8) < 0.08


def test_recall_at_the_threshold_and_the_log(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for c in range(250):
        a, b = jaccard_pair(rnd, 120, rnd.choice((0, 1, 2, 3)))
        if len(sets(a) & sets(b)) * 5 >= len(sets(a) | sets(b)) * 4:
            want.add(2 * c)
        rows += [(2 * c, " ".join(a)), (2 * c + 1, " ".join(b))]
    log = []
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), log=log, depth=8).collect()}
    found = {i for i in want if got[i].class_id == got[i + 1].class_id == i and got[i].n_links == got[i + 1].n_links == 1}
    assert len(found) >= 0.999 * len(want) and all(got[i].n_links == 0 for i in range(0, 500, 2) if i not in want)
    # prefixes get shorter until the estimate reaches the target, and no longer
    assert [x["length"] for x in log] == list(range(8, 8 - len(log), -1))
    assert all(x["recall"] < ngram_join.RECALL for x in log[:-1]) and (log[-1]["recall"] >= ngram_join.RECALL or log[-1]["length"] == ngram_join.prefix_length())


def test_equal_texts_need_no_shortening(spark):
    text = " ".join(f"w{k}" for k in range(50))
    log = []
    ngram_join.join(spark.createDataFrame([(i, text + (" a" if i % 2 else "")) for i in range(6)], "doc_id long, text string"), log=log).collect()
    assert len(log) == 1


def test_blocks_of_a_large_group(spark):
    """A chain of texts, each like its neighbours only, in many blocks."""
    rnd = random.Random(1)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(1200)]
    rows = [(i, " ".join(long[8 * i : 8 * i + 160])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, split = ({(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(df, block=b).collect()} for b in (1024, 8))
    own = [sets(t.split()) for _, t in rows]
    links = [sum(i != j and len(a & b) * 5 >= len(a | b) * 4 for j, b in enumerate(own)) for i, a in enumerate(own)]
    assert whole == split and [n for _, _, n in sorted(whole)] == links
