"""Toxicity learns from labelled texts: wrong labels, odd rows and clashing columns."""

import random

import pyarrow as pa

from octaspark.llm import toxicity

INSULTS = ["blorkhead", "snivelrat", "gruntfool"]


def corpus(seed=4, n=500):
    """Texts of label 1 hold an insult; so do some of label 0, and some of label 1 hold none."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(rnd.choice("abcdefghinorstu") for _ in range(rnd.randrange(3, 8))) for _ in range(50)]
        true = i % 4 == 0
        if true:
            w.insert(rnd.randrange(len(w)), INSULTS[i // 4 % 3])
        label = not true if i % 25 in (4, 8) else true
        rows.append((i, " ".join(w), int(label), true))
    # every insult occurs under label 0 as well
    assert all(any(x in t and not y for _, t, y, _ in rows) for x in INSULTS)
    return rows


def test_noisy_labels(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, true boolean")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert set(INSULTS) <= set(model.words)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert sum(got[i] == t for i, _, _, t in rows) >= 0.98 * len(rows)
    value = model.score(toxicity.text_values(pa.array(["you blor-khead", "a snivexlrat", "b l o r k h e a d here", "plain words only"]), model))
    assert (value[:3] >= 0.5).all() and value[3] < 0.5


def test_odd_rows(spark):
    rows = [(i, t, y) for i, t, y, _ in corpus(n=500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "a blorkhead"), (900, None), (901, ""), (902, "a blorkhead"), (902, "a blorkhead")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS value", "2 AS score", "3 AS c1", "4 AS label", "5 AS octa_c0", "6 AS c0")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert {tuple(r)[2:] for r in out} == {(1, 2, 3, 4, 5, 6)}
    ids = [r.doc_id for r in out]
    assert ids.count(902) == 0 and 900 in ids and 901 in ids and None not in ids
    assert toxicity.clean(docs.limit(0), labels).count() == 0 and toxicity.clean(docs, labels.limit(0)).count() == docs.count()
