"""Features of byte objects, counted in Arrow batches and summed by Spark."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import stream
from ..schemas import PREFIX

_RUN = re.compile(r"[\x09-\x0d\x1c-\x20\x85\xa0]{2,}")
#: White space other than a single space: the rest stays as it is.
_SPACES = re.compile(r"[^\S ]\s*| \s+")
BINS = {
    "byte": (256, lambda b: b),
    "sum": (256, lambda b: (b[:-1] + b[1:]) & 255),
    "difference": (256, lambda b: (b[1:] - b[:-1]) & 255),
    "xor": (64, lambda b: (b[:-1] ^ b[1:]) >> 2),
    "ordered": (512, lambda b: ((b[:-1] * 131) ^ (b[1:] * 17)) & 511),
    "transition": (2048, lambda b: ((b[:-1] * 257 + b[1:]) * 2654435761) & 2047),
    "bigram": (65536, lambda b: (b[:-1] << 8) | b[1:]),
}


#: Counts that a task holds, and bytes of one object that are coded, at a time.
HELD, CODED = 1 << 20, 1 << 18


def coded(raw: bytes, kind: str):
    """The bins of an object's bytes or pairs of neighbours, CODED of them at a time; nothing if it has none."""
    more = kind != "byte"
    for at in range(0, len(raw) - more, CODED):
        yield BINS[kind][1](np.frombuffer(raw[at : at + CODED + more], np.uint8).astype(np.int64))


def view(raw: bytes) -> str:
    """The lower-cased Latin-1 view of the first 4096 bytes, runs of white space made one space."""
    return _RUN.sub(" ", raw[:PREFIX].decode("latin-1").lower())


def ngram_codes(text: str, low: int, high: int) -> np.ndarray:
    """All windows of ``low`` to ``high`` characters (below U+FFFF) as integers: the characters in base 65536, the length above."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = []
    for n in range(low, high + 1):
        if len(c) >= n:
            code = np.full(len(c) - n + 1, n, np.int64)
            for k in range(n):
                code = (code << 16) | c[k : len(c) - n + 1 + k]
            out.append(code)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gram(code: int) -> str:
    """The text of an n-gram's integer."""
    n = code >> 48 if code >> 48 else (code >> 32 if code >> 32 else code >> 16)
    return "".join(chr((code >> 16 * k) & 0xFFFF) for k in reversed(range(int(n))))


def bins(df: DataFrame, kind: str, by: str | None = None, column: str = "raw", cut: int | None = None) -> DataFrame:
    """(by, bin, n): counts of a byte feature over the column, by another column or over all rows.

    A task counts with NumPy and gives a row for each bin and group, not for each byte; it holds HELD counts at most.
    """
    size = BINS[kind][0]
    own = df.select(*([by] if by else []), F.col(column).cast("binary").alias("octa_raw"))
    kind_of = own.schema[by].dataType.simpleString() if by else None

    def run(batches):
        total: dict = {}

        def flush(schema):
            for g, n in total.items():
                some = np.flatnonzero(n)
                cols = [pa.array(some, pa.int64()), pa.array(n[some], pa.int64())]
                if by:
                    cols.insert(0, pa.array([g] * len(some), schema.field(0).type))
                yield pa.RecordBatch.from_arrays(cols, names=[*([by] if by else []), "bin", "n"])
            total.clear()

        for batch in batches:
            groups = batch.column(0).to_pylist() if by else [None] * batch.num_rows
            for g, raw in zip(groups, batch.column(batch.num_columns - 1).to_pylist()):
                for codes in coded((raw or b"")[:cut], kind):
                    if g not in total:
                        if (len(total) + 1) * size > HELD:
                            yield from flush(batch.schema)
                        total[g] = np.zeros(size, np.int64)
                    total[g] += np.bincount(codes, minlength=size)
        if total:
            yield from flush(batch.schema)

    out = stream(own, run, ", ".join([*([f"`{by}` {kind_of}"] if by else []), "bin long, n long"]))
    return out.groupBy(*([by] if by else []), "bin").agg(F.sum("n").alias("n"))


def ngram_counts(df: DataFrame, low: int = 2, high: int = 3, column: str = "raw") -> DataFrame:
    """(gram, df, cf): in how many rows each n-gram of the normalized view occurs, and how often; a task holds HELD n-grams at most."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3

        def out():
            code, d, n = held
            return pa.RecordBatch.from_arrays([pa.array([gram(int(c)) for c in code], pa.string()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["gram", "df", "cf"])

        for batch in batches:
            own = [np.unique(ngram_codes(view(r or b""), low, high), return_counts=True) for r in batch.column(0).to_pylist()]
            code, at = np.unique(np.concatenate([held[0], *(c for c, _ in own)]), return_inverse=True)
            d = np.concatenate([held[1], np.ones(len(at) - len(held[1]), np.int64)])
            n = np.concatenate([held[2], *(n for _, n in own)])
            held = [code, *(np.bincount(at, x, len(code)).astype(np.int64) for x in (d, n))]
            if len(code) > HELD // 4:
                yield out()
                held = [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield out()

    out = stream(df.select(F.col(column).cast("binary")), run, "gram string, df long, cf long")
    return out.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def row_ngrams(df: DataFrame, key: str, low: int = 2, high: int = 3, column: str = "raw") -> DataFrame:
    """(key, gram, tf) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, n = np.unique(ngram_codes(view(r or b""), low, high), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(code), batch.schema.field(0).type), pa.array([gram(int(c)) for c in code], pa.string()), pa.array(n, pa.int64())], names=[key, "gram", "tf"])

    return stream(df.select(key, F.col(column).cast("binary")), run, f"`{key}` {kind}, gram string, tf long")


def tfidf_top(df: DataFrame, key: str, vocab: DataFrame, docs: int, top: int, low: int = 2, high: int = 3, column: str = "raw") -> DataFrame:
    """(key, gram, w): the ``top`` n-grams of every row by TF-IDF, normalized over the vocabulary (gram, df), which is bounded and sent to the executors."""
    known = sorted((int(ngram_codes(r.gram, len(r.gram), len(r.gram))[0]), math.log((1 + docs) / (1 + r.df)) + 1, r.gram) for r in vocab.collect())
    sent = df.sparkSession.sparkContext.broadcast((np.array([k for k, _, _ in known], np.int64), np.array([v for _, v, _ in known]), [g for _, _, g in known]))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        codes, weight, names = sent.value
        for batch in batches:
            rows = []
            for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, n = np.unique(ngram_codes(view(r or b""), low, high), return_counts=True)
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                at, x = at[hit], (1 + np.log(n[hit])) * weight[at[hit]]
                if len(x):
                    x = np.round(x / math.sqrt(float((x * x).sum())), 6)
                    some = np.flatnonzero(x >= np.partition(x, -min(top, len(x)))[-min(top, len(x))]).tolist()
                    rows += [(k, names[at[i]], float(x[i])) for i in sorted(some, key=lambda i: (-x[i], names[at[i]]))[:top]]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=[key, "gram", "w"])

    return stream(df.select(key, F.col(column).cast("binary")), run, f"`{key}` {kind}, gram string, w double")


def vocabulary(counts: DataFrame, min_df: int = 2, most: int = 45_000) -> DataFrame:
    """(idx, gram, df, cf): the most frequent n-grams, numbered in the order of their text."""
    top = counts.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "gram").limit(most)
    from pyspark.sql import Window

    return top.withColumn("idx", F.row_number().over(Window.orderBy("gram")) - 1)  # at most ``most`` rows


def idf(df_count, n):
    """Smooth inverse document frequency."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df_count)) + 1


def normalized(text: str) -> str:
    """The first 4096 characters case-folded, white space made one space."""
    return _SPACES.sub(" ", text[:PREFIX].casefold())


def trigrams(text: str) -> list[str]:
    """Windows of three characters of the normalized text."""
    t = normalized(text)
    return [t[i : i + 3] for i in range(len(t) - 2)]


def row_trigrams(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, gram, tf) of every text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, grams, counts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[str, int] = {}
                for g in trigrams(t or ""):
                    own[g] = own.get(g, 0) + 1
                keys += [k] * len(own)
                grams += own.keys()
                counts += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=[key, "gram", "tf"])

    return stream(df.select(key, column), run, f"`{key}` {kind}, gram string, tf long")


def trigram_totals(df: DataFrame, by: str, column: str = "text") -> DataFrame:
    """(by, n): how many trigrams each text has, a row for each."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([max(0, len(normalized(t or "")) - 2) for t in batch.column(1).to_pylist()], pa.int64())], names=[by, "n"])

    return stream(df.select(by, column), run, f"`{by}` {df.schema[by].dataType.simpleString()}, n long")


def _trigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of normalized texts as integers, a character in 21 bits, and how often each occurs.

    Characters are numbered as they occur, so few of them make a short table
    of counts; texts are told apart by a character that is none.
    """
    none = 0x110000
    x = np.frombuffer(chr(0).join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
    x[ends] = none
    seen = np.flatnonzero(np.bincount(x, minlength=none + 1))
    seen = seen[seen != none]
    n = len(seen)
    names = np.zeros(none + 1, np.int64)
    names[seen] = np.arange(n)
    whole = x != none
    at = np.flatnonzero(whole[:-2] & whole[1:-1] & whole[2:])
    y = names[x]
    code = (y[at] * n + y[at + 1]) * n + y[at + 2]
    if n**3 <= 4 * HELD:
        count = np.bincount(code, minlength=n**3)
        code = np.flatnonzero(count)
        count = count[code]
    else:
        code, count = np.unique(code, return_counts=True)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (seen[code // (n * n)] << 42) | (seen[code // n % n] << 21) | seen[code % n], count


def trigram_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """(gram, n) over all texts; counted by task before anything is shuffled, with HELD / 4 trigrams in hand at most."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 2

        def out():
            grams = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in held[0].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(held[1], pa.int64())], names=["gram", "n"])

        for batch in batches:
            code, count = _trigram_codes([normalized(t or "") for t in batch.column(0).to_pylist()])
            every, at = np.unique(np.concatenate([held[0], code]), return_inverse=True)
            held = [every, np.bincount(at, np.concatenate([held[1], count]), len(every)).astype(np.int64)]
            if len(every) > HELD // 4:
                yield out()
                held = [np.zeros(0, np.int64)] * 2
        if len(held[0]):
            yield out()

    return stream(df.select(column), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
