"""Line dedup against brute force, and odd inputs."""

import random

import pytest

from octaspark.llm import line_dedup


def brute(rows, window, min_lines, long_line):
    """Kept texts of (doc_id, text) rows: fingerprints, earliest occurrences and extension, document by document."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    own = {d: [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(d[2].split("\n")) if x.strip(" \t\r\x0b\x0c")] for d in docs}
    first = {}
    prints = []
    for d in docs:
        lines = [x for _, x in own[d]]
        # with a window of 1 every pair is a fingerprint
        for p in range(len(lines) - 1):
            prints.append((d, p, 2, (lines[p], lines[p + 1])))
        prints += [(d, p, 1, (x,)) for p, x in enumerate(lines) if len(x) >= long_line]
    for d, p, n, key in prints:
        first.setdefault(key, (d, p))
    gone = {d: set() for d in docs}
    for d, p, n, key in prints:
        src, q = first[key]
        if (src, q) == (d, p):
            continue
        a, b = [x for _, x in own[d]], [x for _, x in own[src]]
        lo, hi = 0, n
        while p + lo > 0 and q + lo > 0 and a[p + lo - 1] == b[q + lo - 1]:
            lo -= 1
        while p + hi < len(a) and q + hi < len(b) and a[p + hi] == b[q + hi]:
            hi += 1
        if hi - lo >= min_lines or n == 1:
            gone[d].update(own[d][k][0] for k in range(p + lo, p + hi))
    return {(d[1] if d[0] else None, d[2]): "\n".join(x for k, x in enumerate(d[2].split("\n")) if k not in gone[d]) for d in docs}


@pytest.mark.parametrize("min_lines", [2, 4])
def test_against_brute_force(spark, min_lines):
    rnd = random.Random(min_lines)
    pool = [f"line {k}" for k in range(12)] + ["", "\t", "  ", "z" * 30, "y" * 40]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14)))) for i in range(120)]
    rows += [(500, "\n".join(pool * 3)), (None, "line 1\nline 2\nx"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text): r.kept_text for r in line_dedup.dedup(df, min_lines=min_lines, long_line=30).collect()}
    want = brute(rows, 1, min_lines, 30)
    assert {k: v for k, v in got.items() if k[1] is not None} == want and got[(7, None)] is None


def test_wide_window_extends_matches(spark):
    run = [f"shared {k}" for k in range(12)]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", "d", *run, "e"])), (3, "\n".join(["f", *run[2:9]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.kept_text for r in line_dedup.dedup(df, window=4).orderBy("doc_id").collect()] == [rows[0][1], "c\nd\ne", "f"]


def test_columns_of_any_name_come_back(spark):
    names = ["gone", "octa_gone", "octa_id", "octa_th", "th", "h", "octa_c0", "lines"]
    rows = [(1, "a\nb\nc", *range(8)), (2, "x\na\nb", *range(8)), (2, "x\na\nb", *range(8))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "kept_text", "lines_gone"]
    assert sorted(tuple(r) for r in got.collect()) == sorted([(*rows[0], "a\nb\nc", 0), (*rows[1], "x", 2), (*rows[2], "x", 2)])
