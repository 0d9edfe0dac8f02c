"""Fingerprints where one doc_id, or null, holds a large part of the rows; likeness against exact values."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from octaspark.llm import fingerprint


def test_hot_ids_equal_texts_and_nulls(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 9)))
    rows = [(7, text()) for _ in range(250)] + [(7, "the same words")] * 120 + [(None, text()) for _ in range(90)] + [(None, None)] * 30 + [(i, text()) for i in range(200, 320)] + [(-(2**63), "least"), (2**63 - 1, "most")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("clash")).withColumn("span", F.lit(0))
    got = fingerprint.report(df, range_rows=16).collect()
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.t))
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        k = len(a.t) // 3
        want.append((a.doc_id or 0, len(a.t), hashlib.sha256((a.t[: len(a.t) - k] + b.t[:k]).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def shingles(text):
    """How often each run of three words (all, if a paragraph has fewer) occurs in the paragraphs."""
    out = {}
    for p in text.split("\n"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", p.lower())
        for k in range(max(1, len(w) - 2) if w else 0):
            key = tuple(w[k : k + 3])
            out[key] = out.get(key, 0) + 1
    return out


def test_likeness_is_near_the_exact_one():
    rnd = random.Random(2)
    errors = []
    for _ in range(60):
        own = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 400))]
        cut = rnd.randrange(len(own))
        other = own[:cut] + [f"v{rnd.randrange(4000)}" for _ in range(len(own) - cut)]
        a, b = " ".join(own), " ".join(other)
        x, y = shingles(a), shingles(b)
        exact = 2 * sum(x[k] * y[k] for k in x if k in y) / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))
        u, v = fingerprint.vectors([a.encode()]), fingerprint.vectors([b.encode()])
        errors.append(float(fingerprint.likeness(u, v)[0]) - exact)
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.08 and max(map(abs, errors)) < 0.25


def test_equality_is_256_bits_wide():
    (exact, _) = fingerprint.vectors([b"one\ntwo"])
    assert exact.shape == (1, 4) and len(set(exact[0].tolist())) == 4
    digests = [hashlib.blake2b(p, digest_size=32).digest() for p in (b"one", b"two")]
    want = [sum(int.from_bytes(d[8 * k : 8 * k + 8], "little") for d in digests) % 2**64 for k in range(4)]
    assert exact[0].tolist() == want
