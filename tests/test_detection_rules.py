"""The detection queries without SQL against rules stated anew in plain Python, on the smallest tables."""

import codecs
import hashlib
import re

import pytest

from octaspark.operators import codecs as c
from octaspark.operators import detect as d
from octaspark.operators.model import fit_objects
from octaspark.plans import audit
from octaspark.sources import variants

DATA = "/root/testdata/sf0.001"
LABELS = audit._DETECT_LABELS


@pytest.fixture(scope="module")
def objects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return {(r.doc_id, r.label): bytes(r.raw) for r in variants.codec_variants(docs, LABELS).collect()}


def reads(raw, label):
    """Whether the first 4096 bytes are text of the codec; where more follow, their end may cut a character."""
    decoder = codecs.getincrementaldecoder(label)()
    try:
        decoder.decode(raw[:4096], len(raw) <= 4096)
    except UnicodeDecodeError as e:
        return len(raw) > 4096 and e.end == 4096 and ("truncated" in e.reason or "unexpected end" in e.reason)
    return True


def test_decodable_codecs(spark, objects):
    for r in audit.QUERIES["q51_decodable_codecs"](spark, DATA).collect():
        raw = objects[(r.doc_id, r.label)]
        assert r.possible == [x for x in LABELS if reads(raw, x)] and set(r.impossible) == set(LABELS) - set(r.possible)


def whole(raw, label):
    text = raw.decode("utf-8" if label == "utf-8-sig" else label)
    signs = (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff", b"\x00\x00\xfe\xff")
    return text[1:] if text.startswith("﻿") and raw.startswith(signs) else text


def test_detect_end_to_end(spark, objects):
    right = 0
    rows = audit.QUERIES["q50_detect_end_to_end"](spark, DATA).collect()
    assert len(rows) == len(objects)
    for r in rows:
        raw = objects[(r.doc_id, r.label)]
        if r.encoding is None:
            assert r.ambiguous and not r.accepted and r.text_sha256 is None and r.reason in ("no_candidate", "invalid_selected_codec")
            continue
        text = whole(raw, r.encoding)
        assert r.accepted and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.candidates[0] == r.encoding and len(r.candidates) <= 3
        plain = bool(raw) and len(raw) <= 4096 and not r.bom_present and re.fullmatch(rb"[\t\n\r -~]+", raw) is not None
        assert (r.reason == "textually_ambiguous_ascii") == (plain and r.encoding in ("utf-8", "cp1252", "cp437", "mac_roman", "utf-8-sig"))
        assert r.ambiguous == (r.reason in ("textually_ambiguous_ascii", "utf8_evidence"))
        if r.label in ("utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le") and len(raw) > 256:
            right += 1 - (r.encoding == r.label)
    assert right <= 0.02 * len(rows)


def test_c1_ambiguity(spark):
    for r in audit.QUERIES["q52_c1_ambiguity"](spark, DATA).collect():
        assert r.warning == (r.reason == "c1_interpretation_ambiguous") == bool(r.alternatives)
        assert r.encoding is not None or r.reason == "no_decoded_text"


def test_ambiguity_reasons_in_order():
    found = lambda **k: d.Detection(**{"encoding": "iso8859-1", "text": "\x93a", "candidates": ["iso8859-1", "latin-1", "cp1252", "windows-1252", "koi8-r"]} | k)
    raw = b"\x93a"
    assert d.ambiguity(raw, found()) == (True, "c1_interpretation_ambiguous", ["cp1252", "koi8-r"])
    assert d.ambiguity(raw, found(text=None))[1] == "no_decoded_text" and d.ambiguity(raw, found(bom_present=True))[1] == "bom_present"
    assert d.ambiguity(raw, found(text="a"))[1] == "no_c1_controls" and d.ambiguity(raw, found(encoding="ascii"))[1] == "selected_codec_not_reproducible"
    assert d.ambiguity(raw, found(text="\x94a"))[1] == "result_not_reproducible"
    assert d.ambiguity(raw, found(candidates=["iso8859-1", "l1"]))[1] == "no_alternative_without_c1"
    assert d.plain_instead(raw, found()) == "cp1252" and d.recoverable(raw, ["ascii", "cp1252"], "“a") and not d.recoverable(raw, ["ascii"], "“a")


def test_gate_reasons():
    for label, raw, end in (("utf-8", "é".encode()[:1], "cut"), ("shift_jis", "日".encode("shift_jis")[:1], "open"), ("utf-16-le", b"a\x00b", "open"), ("no-such", b"a", "unknown"), ("ascii", b"\xff", "broken"), ("utf-8", b"a", "whole")):
        got = c.reading(raw, label, False)
        assert got == end or {got, end} == {"cut", "open"}, (label, got)
    g = c.gate(b"\xff", ["ascii", "ascii", "cp1252"])
    assert (g.possible, g.impossible, g.incomplete) == (["cp1252"], ["ascii"], [])


def test_weightings():
    rows = [(b"abab" * 5, "ascii"), (b"ababaa" * 5, "ascii"), ("é".encode() * 9, "utf-8"), ("éa".encode() * 9, "utf-8")]
    m = fit_objects(rows)
    n = {w: (setattr(m, "weighting", w), m.features(b"abababaa")[1])[1] for w in ("sublinear", "plain", "binary")}
    assert all(abs(float((x * x).sum()) - 1) < 1e-9 for x in n.values()) and len({x.round(6).tobytes() for x in n.values()}) == 3
