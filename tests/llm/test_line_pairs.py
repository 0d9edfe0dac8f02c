"""Line dedup against brute force: isolated repeated runs of two lines."""

import random

from octaspark.llm import line_dedup


def test_isolated_pairs_go(spark):
    rnd = random.Random(3)
    pairs = [(f"first {k}", f"second {k}") for k in range(40)]
    rows, want = [], {}
    for i in range(120):
        lines = [f"own {i} {j}" for j in range(rnd.randrange(2, 6))]
        at = rnd.randrange(1, len(lines))
        rows.append((i, "\n".join(lines[:at] + list(pairs[i % 40]) + lines[at:])))
        want[i] = 0 if i < 40 else 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.lines_gone for r in line_dedup.dedup(docs).collect()} == want
