"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers
of two. It does not depend on their order, and inserting or deleting a
paragraph adds or subtracts its vector (:func:`add`, :func:`subtract`).

A vector has two parts. ``EXACT`` lanes modulo 2 ** 64 are a hash of the whole
paragraph, 256 bits of digest: two documents agree there if and only if their
multisets of paragraphs do (up to hash collisions). ``LIKE`` lanes modulo 2 ** 24 count the
paragraph's shingles of three words (all words, if fewer), each with a sign in
one lane: products of two such vectors estimate how many shingles two documents
share, with a standard error of about 1 / sqrt(LIKE). Sums that leave 24 bits
wrap, which spoils only the likeness, never equality.

Null texts count as empty: no paragraphs, all lanes 0; two such are alike (1).
doc_id is an integer. Only doc_id and text are read, whatever the other columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, arrow_map, save, small
from .words import shingles, words

EXACT, LIKE = 4, 256
_MOD = 1 << 24
#: Rows of a range of neighbours.
RANGE_ROWS = 1 << 16


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The exact and the likeness lanes of each text."""
    exact, like = np.zeros((len(texts), EXACT), np.uint64), np.zeros((len(texts), LIKE), np.int64)
    lines = [t.split(b"\n") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    flat = [x for own in lines for x in own]
    full = np.array([bool(x) for x in flat], bool)
    doc, flat = doc[full], [x for x in flat if x]
    if not flat:
        return exact, like
    digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in flat), "<u8").reshape(-1, EXACT)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    exact[doc[begin]] = np.add.reduceat(digest, begin, 0)
    w = words(np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)]))
    sh, first = shingles(w, 3)
    owner = np.repeat(doc, np.diff(first))
    lane = owner * LIKE + (sh >> np.uint64(40)).astype(np.int64) % LIKE
    sign = np.where(sh & np.uint64(1), 1.0, -1.0)
    like += np.bincount(lane, sign, len(texts) * LIKE).astype(np.int64).reshape(like.shape)
    return exact, like % _MOD


def pack(exact: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints as text: the lanes' bytes in base64."""
    narrow = like.astype("<u4").view(np.uint8).reshape(len(like), LIKE, 4)[:, :, :3].reshape(len(like), -1)
    raw = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), narrow], 1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def unpack(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(base64.b64decode(p) for p in prints), np.uint8).reshape(len(prints), EXACT * 8 + LIKE * 3)
    exact = raw[:, : EXACT * 8].copy().view("<u8")
    wide = np.zeros((len(prints), LIKE, 4), np.uint8)
    wide[:, :, :3] = raw[:, EXACT * 8 :].reshape(len(prints), LIKE, 3)
    return exact, wide.reshape(len(prints), -1).view("<u4").astype(np.int64)


def add(a: str, b: str) -> str:
    """The fingerprint of all paragraphs of both."""
    (x, y), (u, v) = unpack([a]), unpack([b])
    return pack(x + u, (y + v) % _MOD)[0]


def subtract(a: str, b: str) -> str:
    """The fingerprint without the paragraphs of ``b``."""
    (x, y), (u, v) = unpack([a]), unpack([b])
    return pack(x - u, (y - v) % _MOD)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of rows: twice the shared shingles over both documents' own, as estimated; 1 for equal fingerprints."""
    x, y = (((v[1] + _MOD // 2) % _MOD - _MOD // 2).astype(np.float64) for v in (a, b))
    total = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(2 * (x * y).sum(1) / np.maximum(total, 1e-9), 0, 1)
    out[(a[0] == b[0]).all(1) & (x == y).all(1)] = 1
    return out


def _pairs(batches):
    """Rows in the order of neighbours: (span, doc_id, text, times, own); a row that isn't own only ends the range.

    A row that stands for several equal ones is its own next, but for the last of them.
    """
    before: tuple | None = None
    todo: list[tuple] = []

    def out():
        ids, texts, times, nexts = zip(*todo)
        cuts = [len(t) - len(t) // 3 for t in texts]
        edited = [t[:c] + n[: len(t) // 3] for t, c, n in zip(texts, cuts, nexts)]
        extra = [i for i in range(len(texts)) if i + 1 == len(texts) or nexts[i] is not texts[i + 1]]
        every, changed = vectors([t.encode() for t in (*texts, *(nexts[i] for i in extra))]), vectors([t.encode() for t in edited])
        follow = np.arange(1, len(texts) + 1)
        follow[extra] = len(texts) + np.arange(len(extra))
        own, other = tuple(v[: len(texts)] for v in every), tuple(v[follow] for v in every)
        own_text, changed_text = pack(*own), pack(*changed)
        cols = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own_text), pa.array(changed_text), pa.array(likeness(own, changed)), pa.array(likeness(own, other)), pa.array(times, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in (SCHEMA + _TIMES).split(", ")])

    size = 0
    for batch in batches:
        for span, doc_id, text, times, own in zip(*(c.to_pylist() for c in batch.columns)):
            if before is not None and before[0] == span:
                todo.append((before[1], before[2], 1, text))
                size += len(text)
                if size >= SLICE_BYTES:
                    yield out()
                    todo, size = [], 0
            if own and times > 1:
                todo.append((doc_id, text, times - 1, text))
                size += len(text)
            before = (span, doc_id, text) if own else None
    if todo:
        yield out()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TIMES = ", times long"


def report(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's.

    Next is the document with the next smaller doc_id, after the last the
    first; rows with one doc_id follow by a hash of the text. A null doc_id
    comes last. A single document is its own next. Texts are shuffled once,
    into ranges of doc_id; the first row of a range is also sent to the range
    before. A doc_id that holds more rows than a range is a row of ranges, by
    the hash of the text, and its equal texts are counted before they are sent.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    n, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if n == 0:
        return docs.select(*[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in SCHEMA.split(", "))]).limit(0)
    ranges = max(n // range_rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # four spans for each partition, so that hashing deals them evenly
    span, hot = _span(ids, 4 * ranges, n, n - known)
    rows = docs.withColumn("th", F.xxhash64("text")).withColumn("span", span)
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    if hot is not None:
        many = rows.filter(hot).groupBy("span", "doc_id", "th", "text").agg(F.sum("times").alias("times")).select(rows.columns)
        rows = rows.filter(~hot).unionByName(many)
    # the first row of each range that has any: a row for each range
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), "th")
    heads = rows.groupBy("span").agg(F.min(first).alias("head"))
    heads = heads.select("span", "head", F.lag("span").over(Window.orderBy("span")).alias("to"))
    heads, _ = save(heads)
    last = heads.agg(F.max("span")).first()[0]
    heads = heads.select("span", "head", F.coalesce("to", F.lit(last)).alias("to"))
    rows = rows.join(small(heads), "span")
    own = F.struct("span", F.lit(True).alias("own"))
    led = F.struct(F.col("to").alias("span"), F.lit(False).alias("own"))
    sent = F.when(first == F.col("head"), F.array(own, led)).otherwise(F.array(own))
    sent = F.when(F.col("doc_id").isNull() & F.col("head.none") & (F.col("th") == F.col("head.th")), F.array(own, led)).otherwise(sent)
    rows = rows.select("doc_id", "text", "th", "times", F.explode(sent).alias("s")).select(F.col("s.span").alias("span"), "doc_id", "text", "times", F.col("s.own").alias("own"), "th")
    rows = rows.repartition(ranges, "span").sortWithinPartitions("span", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "th", "text").drop("th")
    out = arrow_map(rows, _pairs, SCHEMA + _TIMES)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return out.select(names) if hot is None else out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(names)


def _span(ids: DataFrame, ranges: int, n: int, nulls: int) -> tuple[Column, Column | None]:
    """The range of a row, larger doc_ids first, nulls last, and a condition for rows whose doc_id holds several ranges (None: there are none).

    Ranges lie between quantiles, for many ranges evenly within these, and for
    a doc_id that is several quantiles between hashes of the text.
    """
    coarse = min(ranges, 1024)
    marks = [max(-(2**63), min(2**63 - 1, int(m))) for m in ids.dropna().approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 0.1 / coarse)]
    hot = {m: k - 1 for m, k in Counter(marks).items() if k > 2 and n > 4 * ranges}
    marks = sorted({*marks, *(m + 1 for m in hot if m < 2**63 - 1)}) or [0]
    fine = -(-ranges // coarse)
    c = F.col("doc_id")
    places = F.array(*[F.lit(m).cast("long") for m in marks])
    k = F.greatest(F.size(F.filter(places, lambda m: m <= c)), F.lit(1))
    low, high = F.element_at(places, k), F.element_at(places, F.least(k + 1, F.lit(len(marks))))
    share = (c.cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    within = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share * fine))) if fine > 1 else F.lit(0)
    span = (F.lit((len(marks) + 2) * fine) - (k * fine + within)).cast("long")
    parts = fine * nulls * coarse // max(n, 1) + 1
    split = lambda many: F.floor((F.col("th").cast("double") / float(1 << 64) + 0.5) * many).cast("long")
    wide = max([1, *hot.values(), parts]) * fine + 1
    span = span * wide
    if hot:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, v in hot.items() for x in (m, v * fine)]), c), F.lit(1))
        span = span + split(many)
    span = F.when(c.isNull(), F.lit(1 << 50) + split(F.lit(parts))).otherwise(span)
    held = c.isin(list(hot)) if hot else F.lit(False)
    return span, (F.coalesce(held, F.lit(True)) if parts > 1 else F.coalesce(held, F.lit(False))) if hot or parts > 1 else None
