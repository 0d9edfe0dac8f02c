"""Texts with very many repeats of one thing take time in proportion to their length."""

import time

import pytest

from octaspark.llm import line_dedup, pii


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


@pytest.mark.parametrize("lines, left", [(["abc"], "abc"), (["abc", "def", "ghi"], "abc\ndef\nghi")])
def test_line_dedup(spark, lines, left):
    text = "\n".join(lines * (99_999 // len(lines)))
    start = time.time()
    got = line_dedup.dedup(one(spark, text)).first()
    assert got.kept_text.startswith(left) and got.kept_text.count("\n") <= len(lines) and got.lines_gone >= 99_990
    assert time.time() - start < 90


@pytest.mark.parametrize("part, kind", [("a@b.co ", "n_email"), ("password=abc123xyz ", "n_added_secret"), ("+1(2)", None), ("1 ", None), ("a@b", None)])
def test_pii(spark, part, kind):
    start = time.time()
    got = pii.report(one(spark, part * 100_000)).first()
    assert sum(got[c] for c in got.asDict() if c.startswith("n_") and c != "n_added") == (100_000 if kind else 0)
    assert not kind or (got[kind] == 100_000 and got.spans.count(",") == 99_999)
    assert time.time() - start < 90
