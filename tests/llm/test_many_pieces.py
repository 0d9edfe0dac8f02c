"""Substring dedup where the least document holds a repeated passage behind many pieces that are more like it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from octaspark.llm import substring_dedup


def test_pieces_do_not_take_the_place_of_a_near_passage(spark):
    """Eight pieces of 48 words agree with the later passage in more runs of context than the hub's own passage, which differs in a word."""
    rnd = random.Random(12)
    prose = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    rows, later = [], []
    for _ in range(60):
        p, one = prose(60), prose(10)
        k = rnd.choice([*range(8, 14), *range(46, 52)])
        for _ in range(8):
            a = rnd.choice([1, 6, 11])
            one += p[a : a + 48] + prose(12)
        one += prose(20) + p[:k] + ["changed"] + p[k + 1 :] + prose(20)
        later.append(len(rows) + 1)
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(prose(20) + p + prose(20)))]
    found = {(r.doc_id, r.source_id) for r in substring_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # brute force: one word of sixty differs, which is five shingles of 56
    assert sum((i, i - 1) in found for i in later) >= 0.97 * len(later)


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50, 400])
def test_groups_across_batches(cut):
    """Both ways in which windows of a value meet, against plain loops, whatever the batches are."""
    rng = np.random.default_rng(cut)
    rows = sorted({(int(k), int(d), int(c)) for k, d, c in zip(rng.integers(0, 25, 400), rng.integers(0, 7, 400), rng.integers(0, 40, 400))})
    rows = [(k, int(rng.integers(0, 2**62)), d, c, int(rng.integers(0, 9)), int(rng.integers(0, 9))) for k, d, c in rows]
    fields = [("key", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("c", pa.int32()), ("before", pa.int32()), ("after", pa.int32())]

    def batches(rows, fields):
        for i in range(0, len(rows), cut):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows[i : i + cut]), fields)], names=[n for n, _ in fields])

    value = {}
    for r in rows:
        value.setdefault(r[0], []).append(r)
    want = []
    for own in value.values():
        h = own[0]
        if own[-1][2] > h[2]:
            want += [(*r, h[2], r[3] - h[3], r[3] - min(r[4], h[4]), r[3] + min(r[5], h[5])) for r in own]
    plain = batches([(*r, 0, False) for r in rows], [*fields, ("salt", pa.int32()), ("sent", pa.bool_())])
    got = [tuple(x.values())[:-1] for b in substring_dedup._first(plain) for x in b.to_pylist()]
    assert sorted(got) == sorted(want)

    marked = [(k, d, c, b, a, not (k % 3 and d == value[k][0][2])) for k, _, d, c, b, a in rows]
    want = {}
    for k in value:
        own = [r for r in marked if r[0] == k]
        hub = own[0][1]
        least = min((r[1] for r in own if r[5]), default=hub)
        for r in own:
            for h in own:
                if r[5] and h[1] in (hub, least) and r[1] > h[1]:
                    at = (h[1], r[1], r[2] - h[2])
                    lo, hi = r[2] - min(r[3], h[3]), r[2] + min(r[4], h[4])
                    want[at] = (min(lo, want.get(at, (lo, hi))[0]), max(hi, want.get(at, (lo, hi))[1]))
    got = {}
    for b in substring_dedup._every(batches(marked, [fields[0], *fields[2:], ("open", pa.bool_())])):
        for x in b.to_pylist():
            at = (x["hub"], x["doc"], x["shift"])
            got[at] = (min(x["lo"], got.get(at, (x["lo"], 0))[0]), max(x["hi"], got.get(at, (0, x["hi"]))[1]))
    assert got == want
