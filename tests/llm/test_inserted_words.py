"""Verification of passages with inserted words, several of them in one chain of offsets."""

import numpy as np

from octaspark.llm import substring_dedup
from octaspark.llm.words import shingles, words

NEED = 46


def sh(w):
    raw = " ".join(w).encode()
    s, _ = shingles(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), 5)
    return (s >> np.uint64(32)).astype(np.uint32)


def own(tag, n):
    return [f"{tag}{k}" for k in range(n)]


def found(a, b, offsets):
    return sorted(p[2:4] for p in substring_dedup.passages(sh(a), sh(b), offsets, NEED) if p[4] >= 0.8)


def test_two_passages_in_one_chain():
    one, two = own("p", 60), own("q", 60)
    a = own("a", 20) + one + own("b", 40) + two + own("c", 20)
    b = own("d", 20) + one[:30] + ["new"] + one[30:] + own("e", 49) + two[:30] + ["new"] + two[30:] + own("f", 20)
    got = found(a, b, [(0, 0, 80), (1, 20, 120), (10, 90, 180), (11, 120, 200)])
    assert got == [(20, 77), (130, 187)]


def test_stray_sentence_next_to_a_passage():
    one, stray = own("p", 60), own("s", 10)
    a = own("a", 20) + one + own("b", 30) + stray + own("c", 20)
    b = own("d", 20) + one[:30] + ["new"] + one[30:] + own("e", 33) + stray + own("f", 20)
    assert found(a, b, [(0, 0, 80), (1, 20, 90), (4, 80, 140)]) == [(20, 77)]
    assert found(a, b, [(0, 0, 80)]) == [(20, 77)]  # one of the two offsets met


def test_repeated_words_and_nothing_in_common():
    assert found(["x"] * 300, ["x"] * 300, [(0, 0, 295)]) != []
    assert found(own("a", 100), own("b", 100), [(0, 0, 95), (3, 0, 95)]) == []
