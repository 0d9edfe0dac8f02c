"""Byte machines, lossy decoding, route models and script evidence against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaspark.functions import bytesql as B
from octaspark.operators import codecs as c
from octaspark.operators import route


def some_bytes(n=300):
    rnd = random.Random(11)
    text = ["日本語 text ", "naïve ", "漢字かな", "Привет", "한국어", "A"]
    out = [b""]
    for _ in range(n):
        raw = b"".join(rnd.choice(text).encode(rnd.choice(("utf-8", "shift_jis", "euc_jp", "big5", "gb18030")), "ignore") for _ in range(rnd.randrange(1, 6)))
        out += [raw, raw[: rnd.randrange(len(raw) + 1)], bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 9)))]
    return out


def machine(raw, encoding):
    """Reads one character after another; what follows a lead byte is given by ranges."""
    kana, two, upper = (0xA1, 0xDF), (0xA1, 0xFE), (0x81, 0xFE)
    inside = lambda v, *spans: any(a <= v <= b for a, b in spans)

    def follow(lead):
        if lead <= 0x7F or (encoding == "shift-jis" and inside(lead, kana)):
            return []
        if encoding == "shift-jis" and inside(lead, (0x81, 0x9F), (0xE0, 0xFC)):
            return [((0x40, 0x7E), (0x80, 0xFC))]
        if encoding == "euc-jp":
            return [(kana,)] if lead == 0x8E else [(two,), (two,)] if lead == 0x8F else [(two,)] if inside(lead, two) else None
        if encoding == "big5" and inside(lead, upper):
            return [((0x40, 0x7E), two)]
        if encoding == "gb18030" and inside(lead, upper):
            return "gb"
        return None

    i = 0
    while i < len(raw):
        rest = follow(raw[i])
        if rest is None:
            return "invalid", i
        if rest == "gb":
            four = i + 1 < len(raw) and 0x30 <= raw[i + 1] <= 0x39
            rest = [((0x30, 0x39),), (upper,), ((0x30, 0x39),)] if four else [((0x40, 0x7E), (0x80, 0xFE))]
        for k, spans in enumerate(rest, 1):
            if i + k >= len(raw):
                return "incomplete", len(raw)
            if not inside(raw[i + k], *spans):
                return "invalid", i + k
        i += len(rest) + 1
    return "valid", len(raw)


def test_machines_and_lossy_reading(spark):
    some = some_bytes()
    df = spark.createDataFrame(list(enumerate(some)), "id int, raw binary")
    raw = F.col("raw")
    got = df.select("id", *[B.machine(raw, e).alias(e) for e in B.MACHINES], B.lossy_utf8(raw).alias("lossy"), B.trimmed(raw).alias("trimmed")).collect()
    for r in got:
        b = some[r.id]
        for e in ("shift-jis", "euc-jp", "big5", "gb18030"):
            assert tuple(r[e]) == machine(b, e), (b, e)
        try:
            b.decode()
            want = ("valid", len(b))
        except UnicodeDecodeError as x:
            want = ("incomplete" if x.reason == "unexpected end of data" and x.end == len(b) else "invalid", x.start)
        assert tuple(r["utf-8"]) == want, b
        text = b.decode("utf-8", "replace")
        assert tuple(r.lossy) == (text.count("\ufffd"), len(text)), b
        assert r.trimmed == next((b[: len(b) - k] for k in range(min(4, len(b) + 1)) if c.strict(b[: len(b) - k], "utf-8") is not None), None)


def test_evidence_and_vectors():
    text = "ひらがなカタカナ漢字abc"
    v = route.evidence_vector(text.encode("shift_jis"))
    assert v[1] == 1 and math.isclose(v[5], 8 / 13) and v[0] == 0
    assert route.evidence_vector("Привет".encode("cp1251"))[8] == 1.0
    b = route.sample(bytes(range(256)) * 4)
    assert len(b) == 768 and len(route.base_vector(b)) == 518 and len(route.extra_vector(b, "U")) == 368 and not route.extra_vector(b, "RL").any()
    assert math.isclose(route.base_vector(b)[:256].sum(), 1) and math.isclose(route.ordered_vector(b).sum(), 1)
    assert {k: len(x) for k, x in route.variants(b"abc").items()} == {"base": 518, "base_logic": 528, "base_ordered": 1030, "combined": 1040}


def case(scores, raw=b"abc"):
    labels = sorted(scores, key=scores.get, reverse=True)
    return route.Case(raw, route.Signals.of(raw), scores, labels)


def test_rules():
    assert route.by_rules(case({"cp1252": 2, "utf-8-sig": 1}, b"\xef\xbb\xbfa")) == "utf-8-sig"
    assert route.by_rules(case({"cp1252": 2, "utf-8": 1}, "é".encode())) == "utf-8" and route.by_rules(case({"koi8-r": 2, "utf-8": 1})) == "koi8-r"
    assert route.by_rules(case({"koi8-r": 2, "ascii": 1}, b"a")) == "ascii"
    assert route.by_rules(case({"cp1257": 3, "x": 2, "iso-8859-1": 1}, b"\xe9")) == "iso-8859-1"
    assert route.by_rules(case({"cp1257": 4, "x": 3, "y": 2, "iso-8859-1": 1}, b"\xe9")) is None


def test_gates():
    c3 = case({"utf-8": 3.0, "gb18030": 2.0, "cp1251": 1.0}, b"\xe9")
    head = route.Head(["cp1251", "gb18030", "utf-8"], np.zeros((3, 17)), np.array([0.0, 5.0, 0.0]))
    assert route.triad(c3, head, "utf-8") == "gb18030" and route.triad(c3, head, "koi8-r") is None
    head.bias = np.array([1.0, 1.0, 1.0])
    assert route.triad(c3, head, "utf-8") is None
    two = route.Head(["utf-8", "gb18030"], np.zeros((1, 14)), np.array([1.0]))
    assert route.pair(c3, two, route.CHINESE_PAIR, "utf-8") == "gb18030" and route.pair(c3, two, route.SIGNATURE_PAIR, "utf-8") is None
    weight = np.zeros((1, 11 + 3 + 1))
    weight[0, 3] = 1  # the place in the order counts: the third of three wins
    assert route.calibrated(c3, route.Head(["n", "y"], weight, np.zeros(1)), ["cp1251", "gb18030", "utf-8"], ["utf"]) == "cp1251"
    assert len(route.specialist_vector(c3)) == 19 and route.specialist_vector(c3)[1] == route.MISSING_SCORE and route.specialist_vector(c3)[6] == route.MISSING_RANK


def test_fit_and_rank(spark):
    rows = [(f"heiße Größe Übung {i} ".encode(e) * (3 + i % 5), e) for i in range(40) for e in ("cp1252", "utf-16-le", "cp437")]
    model, report = route.fit(spark.createDataFrame(rows, "raw binary, encoding string"))
    assert sum(route.rank(r, model)[0] == e for r, e in rows) >= 0.95 * len(rows)
    assert {r.label for r in report.collect()} == {"cp1252", "utf-16-le", "cp437"} and set(model.base.routes) == set(route.ROUTES)
    got = route.detect(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "id int, raw binary"), model).collect()
    assert all(r.labels == route.rank(rows[r.id][0], model)[:3] for r in got)
    # with a specialist that is sure, route RL takes its label
    raw = b"plain text with one odd byte " * 5 + b"\xff"
    assert route.Signals.of(raw).route == "RL"
    model.specialist = route.Head(["cp437", route.OTHER, "cp1252"], np.zeros((3, 19)), np.array([9.0, 0.0, 0.0]))
    assert route.rank(raw, model)[0] == "cp437"
    with pytest.raises(ValueError):
        route.Stack({"U": model.base.routes["U"]})
