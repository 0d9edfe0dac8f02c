"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octaspark.llm import components, decontaminate, fingerprint, line_dedup, ngram_join, packing, pii, shards, substring_dedup, toxicity, url_filter
from octaspark.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}é" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Random prose with exact and near copies, shared passages, empty, null and very long texts, and columns that clash."""
    rnd = random.Random(5)
    texts = [" ".join(prose(rnd, rnd.randrange(30, 300))) for _ in range(40)]
    texts += texts[:6] + [t.replace("w1", "W1") for t in texts[6:9]]
    near = prose(rnd, 200)
    texts += [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (20, 90, 150, 190)] + [" ".join(near)]
    passage = " ".join(prose(rnd, 60))
    texts += [" ".join(prose(rnd, 80)) + "\n" + passage + "\n" + " ".join(prose(rnd, 40)) for _ in range(5)]
    texts += ["", None, "   \n", "one", "One!", "one two three", "x" * 50_000, " ".join(prose(rnd, 20_000)), "é" * 10]
    rows = [(i * 3, t, "n", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, n_words int").repartition(5), {i: t for i, t, _, _ in rows}


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus[0].limit(0)


def test_words_and_shingles():
    texts = ["Hello world's a", "", "éa BC 12", "one two three four five six ONE two three four five"]
    raw = [t.encode() for t in texts]
    w = W.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), True)
    assert w.count.tolist() == [len(tokens(t)) for t in texts]
    sh, first = W.shingles(w)
    assert np.diff(first).tolist() == [1, 0, 1, 7] and sh[first[3]] == sh[first[3] + 6]


def test_op1(corpus, empty):
    df, texts = corpus
    got = substring_dedup.find(df).collect()
    runs = {}
    for i, t in texts.items():
        w = tokens(t)
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    shared = [s for s in runs.values() if len(s) > 1]
    cls = {r.doc_id: r.class_id for r in got}
    for s in shared:
        assert len({cls.get(i) for i in s}) == 1 and None not in {cls.get(i) for i in s}
    for r in got:
        assert r.n_words >= 50 and r.similarity >= 0.8 and len(tokens(texts[r.doc_id])[r.start : r.start + r.n_words]) == r.n_words
    assert substring_dedup.find(empty).count() == 0


def test_compact_windows():
    h = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    first = np.array([0, 80, 80, 200, 205, 300])
    got = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, first, 10))))
    want = set()
    for a, b in zip(first[:-1], first[1:]):
        for k in range(a, b):
            i = j = k
            while i > a and h[i - 1] > h[k]:
                i -= 1
            while j + 1 < b and h[j + 1] > h[k]:
                j += 1
            if j - i + 1 >= 10:
                want.add((k, i, j))
    assert got == want


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * shards.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_op2(spark, corpus, empty):
    df, texts = corpus
    df = df.withColumn("shard", F.lit("clash"))
    got = shards.report(df).collect()
    by = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), jump(r.doc_id, 24), jump(r.doc_id, 25))
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    odd = spark.createDataFrame([(k,) for k in (-1, -(2**63), 2**63 - 1, 0, None)], "doc_id long")
    assert [r.shard for r in shards.assign(odd, 24).collect()] == [jump((k or 0) % 2**64, 24) for k in (-1, -(2**63), 2**63 - 1, 0, None)]
    assert shards.report(empty).count() == 0
    twice = shards.slots(spark.createDataFrame([(1, 0)] * 50, "doc_id long, shard int"))
    assert sorted(r.slot for r in twice.collect()) == list(range(50))


def test_op3(spark):
    rnd = random.Random(2)
    bad = ["blorkhead", "snivelrat", "gruntfool"]
    rows = []
    for i in range(400):
        w = prose(rnd, 60, 3000)
        w = ["".join(rnd.choice("abcdefghinorstu") for _ in range(rnd.randrange(3, 8))) for _ in w]
        if toxic := i % 5 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(1, None), (10**6, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.report(df.drop("toxic"), labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    m = toxicity.fit(df.drop("toxic"), labels)
    hide = pa.array(["a blor-khead!", "blorxkhead", "b l o r k h e a d now", "", "nothing here", "y" * 100_000])
    v = m.score(toxicity.text_values(hide, m))
    assert (v[:3] >= 0.5).all() and (v[3:] < 0.5).all()
    none = toxicity.report(df.drop("toxic"), labels.limit(0))
    assert none.filter("score = 0").count() == 400
    assert toxicity.report(df.drop("toxic").limit(0), labels).count() == 0


def test_kernel():
    def brute(s, t, p=3, d=0.7):
        from itertools import combinations

        def weights(x):
            out = {}
            for at in combinations(range(len(x)), p):
                out.setdefault("".join(x[i] for i in at), []).append(d ** (at[-1] - at[0] + 1))
            return out

        a, b = weights(s), weights(t)
        return sum(sum(v) * sum(b[k]) for k, v in a.items() if k in b)

    words = ["stupid", "stupxid", "trash", "abc"]
    got = toxicity.kernel(toxicity.letters(words, 0)[:, None, :], toxicity.letters(words, -1)[None])
    assert np.allclose(got, [[brute(a, b) for b in words] for a in words], rtol=1e-4)


def test_op4(spark):
    urls = ["http://example.net/en/a", "https://a.EXAMPLE.net/de?x", "http://net/", "http://net", "http://badnet/", "http://x.example.com/de/1", "http://example.com/den", "http://a.org/fr/#x",
            "http://q.com/a.example.net/en/", "no scheme", None, "", "://", "http://é.com/ads/x", "http://z.com/track1/", "http://z.com/f.exe?x", "http://a.net/" + "x" * 20_000, "http://q.com#://net/", "http://a.com/tracké/", "http://a.com/track😀/", "http://a.com/trackéé/", "http://a.com/track/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    for r in url_filter.judge(df).collect():
        host, path = url_filter.parts(urls[r.page_id])
        fit = [(len(k), v, k) for v, k in url_filter.RULES if ("." + host).endswith("." + k.partition("/")[0]) and path.startswith("/" + k.partition("/")[2])]
        block = "/ads/" in host + path or re.search(r"/track./", host + path) or (host + path).endswith(".exe")
        want = (max(fit)[2], max(fit)[1]) if fit else (None, "block" if block else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_op5(corpus, empty):
    df, texts = corpus
    path = packing.vocabulary_path()
    tokenizer = packing._encoder(path)[0]
    got = packing.pack(df, cell=16).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for i, rows in by.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(k, s, min(4096, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 4096))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for rows in seqs.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist() and sum(r.length for r in rows) <= 4096
    assert len(seqs) <= -(-sum(r.length for r in got) // 4096) + 2
    assert packing.pack(empty).count() == 0


def test_token_ids_equal_the_library():
    rnd = random.Random(1)
    odd = ["", "  ", "don't we'll <|endoftext|> a<|startoftext|>b", "É́ é İ K \x01 a\x01b", "ÀÉ÷ß ªº x.,!! a_b 12ab é'S"]
    odd += ["".join(rnd.choice("aBé Ü\n'.,!<|>_-1२你\x01") for _ in range(60)) for _ in range(200)]
    ids, at = packing.token_ids(pa.array(odd), packing.vocabulary_path())
    want = packing._encoder(packing.vocabulary_path())[0].encode_batch(odd, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in want]


def test_op5_pieces_that_fill_half_a_sequence(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))  # 7 tokens each
    got = packing.pack(docs, capacity=10, cell=16).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("last")).collect()
    assert len(got) == 40 and {(r.n, r.last) for r in got} == {(7, 0)}


@pytest.mark.parametrize("part_bytes", [4 << 20, 200])
def test_op6(spark, corpus, empty, part_bytes):
    df, texts = corpus
    rnd = random.Random(8)
    items = [(k, " ".join(tokens(t)[5:40])) for k, (i, t) in enumerate(texts.items()) if t and k % 4 == 0] + [(900, "One"), (901, "one two"), (902, ""), (903, None), (904, " ".join(prose(rnd, 30))), (905, "one, TWO. three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pats = {}
    for k, t in items:
        w = tokens(t)
        m = min(8, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    for r in decontaminate.report(df, bench, part_bytes=part_bytes).collect():
        w, hit, own = tokens(texts[r.doc_id]), set(), set()
        for m in {len(p) for p in pats}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in pats:
                    hit.update(range(i, i + m))
                    own |= pats[p]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(own), len(own) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(df, bench.limit(0)).filter("n_items > 0").count() == 0
    kept = decontaminate.clean(df, bench, part_bytes=part_bytes)
    leaks = set()
    for i, t in texts.items():
        w = tokens(t)
        own = {m: {p for k in range(len(w) - m + 1) if (p := tuple(w[k : k + m])) in pats} for m in {len(p) for p in pats}}
        if own[8] or len({x for found in own.values() for p in found for x in pats[p]}) >= 2:
            leaks.add(i)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(texts) - leaks and leaks


@pytest.mark.parametrize("block", [1024, 2])
def test_op7(spark, corpus, empty, block):
    df, texts = corpus
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    link = {i: {j for j in sets if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}

    def cls(i):
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    got = ngram_join.join(df, block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (cls(i), len(link[i])) for i in sets}
    assert {r.doc_id for r in got if r.keep} == {cls(i) for i in sets}
    assert ngram_join.join(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_links) for r in ngram_join.join(odd).collect()) == [(0, 0), (0, 2), (4, 2), (4, 2)]
    assert ngram_join.join(odd).filter("keep").count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 61)}) == 1 and len({got[i] for i in range(100, 130)}) == 1 and got[1] != got[100]


def test_op8(spark):
    a = [f"line number {i} of the first text" for i in range(10)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["new", *a[3:8], "", "other"])), (3, "\n".join(["x", a[0], "y"])), (4, "z" * 200 + "\nq"), (5, "p\n" + "z" * 200), (6, ""), (7, None), (8, "k\nl\nm\nn\nk\nl\nm"), (2, "another"), (1, "\n".join(a)), (None, "w\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(7))
    got = sorted(((r.doc_id or 0, r.kept_text, r.lines_gone) for r in line_dedup.dedup(df).collect()), key=repr)
    want = [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "new\n\nother", 5), (3, rows[2][1], 0), (4, rows[3][1], 0), (5, "p", 1), (6, "", 0), (7, None, 0), (8, "k\nl\nm\nn", 3), (2, "another", 0), (0, "w\n\n", 0)]
    assert got == sorted(want, key=repr)
    assert line_dedup.report(df.limit(0)).count() == 0


def test_op8_hot_source(spark, monkeypatch):
    rows = [(i, f"own {i}\nshared one\nshared two\nshared three\nend {i}") for i in range(30)] + [(40 + i, f"a {i}\nshared three\nb {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = line_dedup.dedup(df).select("doc_id", "kept_text").orderBy("doc_id").collect()
    monkeypatch.setattr(line_dedup, "SHARE", 2)
    got = line_dedup.dedup(df).select("doc_id", "kept_text").orderBy("doc_id").collect()
    assert got == want and [r.kept_text for r in got] == [rows[0][1]] + [f"own {i}\nend {i}" for i in range(1, 30)] + [t for _, t in rows[30:]]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    luhn = sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_op9(spark):
    rnd = random.Random(3)
    texts = ["", None, "a@b.c_d@e.f x@y.z@w.v é🚀a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 00.001.2.0255", "4111 1111 1111 1111 4111111111111111", "+1 (988) 555-2485 +1+2 12345678 +49(((  12 34 56 78)))9",
             "call 415-555-1234; bob [at] mail [dot] com password=abcdef0123", "1." * 3000 + "a@" * 2000, "a" * 100_000 + "@"]
    texts += ["".join(rnd.choice("ab1.2@+- ()_%é🚀") for _ in range(rnd.randint(5, 120))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(0))
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        own = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in own).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in own) for k in BASE]
        assert {"%s:%d:%d" % x for x in own} <= set(got[i].spans.split(","))
    assert pii.report(df.limit(0)).count() == 0


def test_em_finds_the_better_labeler():
    counts = [((1, 1, 2, 1, 1), 40.0), ((0, 0, 2, 1, 1), 40.0), ((1, 0, 2, 0, 1), 3.0), ((0, 1, 2, 1, 0), 3.0)]
    _, _, post = pii.reliabilities(counts)
    assert post[0] > 0.9 and post[1] < 0.5


def test_op10(corpus, empty):
    df, texts = corpus
    got = {r.doc_id: r for r in fingerprint.report(df, range_rows=7).collect()}
    ids = sorted(texts, reverse=True)
    by = {}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        s, n = texts[i] or "", texts[j] or ""
        k = len(s) // 3
        assert got[i].n_chars == len(s) and got[i].edited_sha256 == hashlib.sha256((s[: len(s) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        by.setdefault(s, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in by.values()) and len({p for s in by.values() for p in s}) == len({s.strip("\n") or s.strip() for s in by if s.strip()} | {s for s in by if not s.strip()})
    long = [i for i in ids if len((texts[i] or "").split()) > 100]
    assert sum(got[i].near_edited > got[i].near_next for i in long) >= 0.85 * len(long)
    assert fingerprint.report(empty).count() == 0


def test_fingerprint_is_homomorphic():
    one, two, both = (fingerprint.pack(*fingerprint.vectors([t.encode()]))[0] for t in ("a b c d", "e f g", "e f g\na b c d"))
    assert fingerprint.add(one, two) == both and fingerprint.subtract(both, two) == one
