"""Substring dedup where the least document holds a repeated passage in part only."""

import random

from octaspark.llm import substring_dedup


def test_partial_hub_does_not_hide_a_repeat(spark):
    rnd = random.Random(8)
    rows, pairs = [], []
    for k in range(60):
        own = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
        passage = own(rnd.choice([50, 55, 60]))
        if k % 3 == 0:  # cut short
            part = passage[rnd.randrange(5):][:44]
        elif k % 3 == 1:  # edited
            part = [w if i % 12 else "edited" for i, w in enumerate(passage)]
        else:  # whole for one later document, in part for the other
            part = passage[:40]
        for i, body in enumerate((part, passage, passage)):
            rows.append((3 * k + i, " ".join(own(30) + body + own(30))))
        pairs.append((3 * k + 1, 3 * k + 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.source_id): r for r in substring_dedup.find(docs).collect()}
    # brute force: every pair shares 50 words or more exactly
    assert [p for p in pairs if (p[1], p[0]) not in got] == []
