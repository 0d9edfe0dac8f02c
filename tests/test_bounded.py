"""What grows with the tables elsewhere: pieces of batches, naive Bayes where objects are read."""

import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from octaspark import cluster
from octaspark.functions import bytesql, features
from octaspark.operators import bayes, corpus, detect, engines, model, route
from octaspark.plans import audit

TEXTS = [(1, "de", "Grüße aus der Stadt " * 20), (2, "en", "the quick brown fox " * 9), (2, "en", "jumps over"), (3, "en", "x"), (4, "de", ""), (5, "fr", "été " * 90_000)]


def plain(rows, bin_, size, cut):
    """Scores by dictionaries."""
    own, per = {}, {}
    for key, label, raw in rows:
        n = Counter(bin_(a, b) for a, b in zip(raw[:cut], raw[1:cut]))
        if n:
            own.setdefault(key, Counter()).update(n)
            per.setdefault(label, Counter()).update(n)
    out = {}
    for key, n in own.items():
        for label, m in per.items():
            total = sum(m.values()) + 0.5 * size
            out[key, label] = sum(k * math.log((m[b] + 0.5) / total) for b, k in n.items()) / sum(n.values())
    return out


def test_batches_are_cut_by_bytes(spark):
    df = spark.range(20_000, numPartitions=1).selectExpr("repeat('x', 1000) AS t")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["size", "rows"])

    got = cluster.stream(df, run, "size long, rows long").collect()
    assert sum(r.rows for r in got) == 20_000 and max(r.size for r in got) <= cluster.PIECE_BYTES
    whole = pa.RecordBatch.from_arrays([pa.array(["a" * 3_000_000, "b", "c" * 900_000, "d" * 900_000])], names=["t"])
    assert [x.num_rows for x in cluster.pieces([whole])] in ([1, 2, 1], [1, 1, 1, 1]) and [t for x in cluster.pieces([whole]) for t in x.column(0).to_pylist()] == whole.column(0).to_pylist()


def test_scores_where_objects_are_read(spark, monkeypatch):
    rows = [(k, label, t.encode()) for k, label, t in TEXTS]
    df = spark.createDataFrame(rows, "id int, lang string, raw binary")
    for kind, bin_, cut in (("bigram", lambda a, b: a << 8 | b, 4096), ("transition", lambda a, b: (a * 257 + b) * 2654435761 & 2047, 4096), ("bigram", lambda a, b: a << 8 | b, None)):
        size = features.BINS[kind][0]
        model = bayes.fit(df, "lang", kind=kind, cut=cut)
        want = plain(rows, bin_, size, cut)
        for labels in (64, 1):  # sent out, and joined
            monkeypatch.setattr(bayes, "SENT_LABELS", labels)
            got = {(r.id, r.lang): (r.score, r.octa_n) for r in bayes.score_objects(df, model, "id", "lang", kind=kind, cut=cut).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k]) for k in want)
        assert got[2, "en"][1] == 9 * 20 - 1 + 9


def test_few_counts_are_held(spark, monkeypatch):
    monkeypatch.setattr(features, "HELD", 65536 * 2)
    df = spark.createDataFrame([(i % 7, bytes([i, i + 1, i])) for i in range(50)], "k int, raw binary")
    got = {(r.k, r.bin): r.n for r in features.bins(df, "bigram", "k").collect()}
    want = Counter(x for i in range(50) for x in ((i % 7, i << 8 | i + 1), (i % 7, (i + 1) << 8 | i)))
    assert got == dict(want)


def test_bigrams_of_whole_texts(spark, tmp_path):
    """Two documents that differ after their first 4096 bytes only."""
    rows = [(1, "de", "a" * 5000 + "bc" * 400), (2, "en", "a" * 5000 + "xy" * 400)]
    spark.createDataFrame(rows, "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain([(k, label, t.encode()) for k, label, t in rows], lambda a, b: a << 8 | b, 65536, None)
    got = {(r.doc_id, r.lang): r.score for r in audit.QUERIES["q28_bigram_nb_score"](spark, str(tmp_path)).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()} and got[1, "de"] > got[1, "en"]


def test_counts_of_tasks(spark, monkeypatch):
    """Whatever a task holds at a time, the counts are the same."""
    texts = [f"Straße  {i % 5}\t\nwo {chr(97 + i % 26)}{chr(98 + i % 7)} " * (1 + i % 4) for i in range(60)]
    df = spark.createDataFrame([(i, t, t.encode()) for i, t in enumerate(texts)], "id int, text string, raw binary").repartition(3)
    for held in (features.HELD, 40):
        monkeypatch.setattr(features, "HELD", held)
        tri, low = Counter(), Counter()
        docs = Counter()
        for t in texts:
            u = " ".join(t.casefold().replace("\t", " ").replace("\n", " ").split(" ")).replace("   ", " ").replace("  ", " ")
            tri.update(u[i : i + 3] for i in range(len(u) - 2))
            v = features.view(t.encode())
            own = Counter(v[i : i + n] for n in (2, 3) for i in range(len(v) - n + 1))
            low.update(own)
            docs.update(own.keys())
        assert {r.gram: r.n for r in features.trigram_counts(df).collect()} == dict(tri)
        assert {r.gram: (r.df, r.cf) for r in features.ngram_counts(df).collect()} == {g: (docs[g], n) for g, n in low.items()}
        assert sum(r.n for r in features.trigram_totals(df, "id").collect()) == sum(tri.values())


def test_totals_of_equal_keys(spark, tmp_path):
    """Two rows of one doc_id count once each."""
    spark.createDataFrame([(1, "en", "abcde"), (1, "en", "abcd")], "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in audit.QUERIES["q94_trigram_totals"](spark, str(tmp_path)).collect()] == [("en", 5, 2)]


def test_lanes_of_odd_objects(spark):
    """NUL bytes by lane; what is left of a step at the end, or beyond the prefix, isn't counted."""
    rng = random.Random(3)
    raws = [b"", b"\x00", b"\x00\x00\x00", b"\n\x00" * 40, b"\x00" * 5000, "aé\n".encode("utf-32-be") * 30]
    raws += [bytes(rng.choice(b"\x00\x00a\n\xff\x85") for _ in range(n)) for n in (5, 31, 32, 33, 64, 257, 4095, 4097, 6000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw binary")
    lanes = [(s, k) for s in (2, 4) for k in range(s)]
    for r in df.select("id", *[bytesql.lanes(F.col("raw"), s, k) for s, k in lanes]).collect():
        p = raws[r[0]][:4096]
        assert list(r[1:]) == [p[: len(p) // s * s][k::s].count(0) for s, k in lanes], r[0]


def test_engines_see_an_object_once(spark):
    """Every row of every engine, keys that occur twice too, without a shuffle of the objects."""
    texts = ["Grüße aus der Straße", "naïve façade", "plain words only", "señor café"]
    rows = [(i % 5, e, (t * (2 + i % 3)).encode(e)) for i, t in enumerate(texts * 6) for e in ("utf-8", "cp1252", "utf-16-le")]
    df = spark.createDataFrame(rows, "id int, label string, raw binary")
    l2 = model.fit_objects(sorted({(r, e) for _, e, r in rows if r not in {x for _, y, x in rows if y != e}}))
    found = engines.compare(df, {"l2": engines.linear(l2), "nb": engines.transitions(bayes.fit(df, "label"), "label"), "bytes": engines.structure()}, ["id", "label"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.engine, r.id, r.label, r.guess) for r in found.collect())
    want = Counter(("l2", i, e, detect.detect_bytes(r, l2).encoding) for i, e, r in rows)
    best = {(r.octa_k): r.label for r in bayes.rank(bayes.score_objects(df.drop("label").dropDuplicates(["raw"]).withColumn("octa_k", F.sha2("raw", 256)), bayes.fit(df, "label"), "octa_k", "label"), "octa_k", "label", 1).collect()}
    import hashlib

    want += Counter(("nb", i, e, best[hashlib.sha256(r).hexdigest()]) for i, e, r in rows)
    assert {k: n for k, n in got.items() if k[0] != "bytes"} == dict(want) and sum(got.values()) == 3 * len(rows)


def test_guesses_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def guess(i):
        calls.add(1)
        return "a" if i % 3 else "b"

    df = spark.range(300).select("id", F.lit("a").alias("label")).withColumn("guess", guess.asNondeterministic()("id"))
    left = {r.id for r in corpus.residual(df, "label", "guess", "id").select("id", "label").collect()}
    right = [i for i in range(300) if i % 3]
    assert left == set(range(300)) - set(right[:105]) and calls.value <= 600  # once for the keys, once for the rows themselves


def test_variants_in_one_pass(spark):
    raws = [b"", "Grüße\n".encode() * 200, "ひらがな".encode("shift_jis"), "Привет".encode("cp1251")]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw binary")
    for r in route.variant_vectors(df, "id").collect():
        assert all(r[k] == v.tolist() for k, v in route.variants(raws[r.id]).items())


def test_language_scores_of_odd_texts():
    for grams in ({"abc": 3, "bc ": 1, "ñan": 7}, {}, {chr(200 + i) + "ab": i for i in range(300)}, {"\U0001f600ab": 2, "abc": 1}):
        m = model.Language(grams)
        for text in ("abc  \tABC ñanñan x", "\U0001f600ab" * 9, "a" * 11, "a" * 14, "Straße \u3000 \x1c x" * 3, "\ud800" * 20):
            own = features.trigrams(text)
            total = math.log(sum(grams.values()) + 0.5 * (len(grams) + 1))
            want = sum(math.log(grams.get(g, 0) + 0.5) for g in own) / len(own) - total if len(own) >= 12 else None
            got = m.score(text)
            assert got is want is None or math.isclose(got, want, abs_tol=1e-12)


def test_trigram_codes_of_odd_texts():
    """Counted by a short table and by sorting; no trigram reaches over two texts."""
    for texts in ([""], ["ab"], ["", "abc", "", "abcabc", "x"], ["\x00\x00\x00a", "\U0010ffffab\U0010ffff"], ["".join(map(chr, range(300, 900))), "abc"]):
        code, n = features._trigram_codes(texts)
        got = {"".join(chr(int(c) >> k & 0x1FFFFF) for k in (42, 21, 0)): m for c, m in zip(code, n.tolist())}
        assert got == dict(Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2)))


def test_masked_as_by_expression(spark):
    raws = [b"", b"charset=", b"x CharSet = 'utf-8' charset=charset=koi8-r;", b"charset=" + b"a" * 70 + b" b", b"charset =         far charset\t=\n\"x.y:z_1", b"charset=\xe9a charset='\"b charset=c\xffd", b"mycharset=charset =q"]
    rng = random.Random(5)
    raws += [b"".join(rng.choice([b"charset", b"=", b" ", b"'", b"ab", b"\xe9", b"CHARSET=", b"-" * 40]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw binary")
    want = df.select("id", F.encode(bytesql.mask_charset(bytesql.latin1(F.col("raw"))), "ISO-8859-1").alias("m")).collect()
    assert all(corpus.masked(raws[r.id]) == bytes(r.m) for r in want)
    plan = corpus.masked_windows(df.select(F.col("id").alias("doc_id"), F.lit("utf-8").alias("label"), "raw"), "raw", "label")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan
