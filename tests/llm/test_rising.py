"""The chain of equal shingles of two texts that repeat lines: the longest one, and not place by place."""

from bisect import bisect_left

import numpy as np
import pytest

from octaspark.llm import substring_dedup


def by_one(x: list[int]) -> list[int]:
    """The chain by patience sorting with a predecessor for each place."""
    ends, at, back = [], [], []
    for k, v in enumerate(x):
        where = bisect_left(ends, v)
        back.append(at[where - 1] if where else -1)
        if where == len(ends):
            ends.append(v)
            at.append(k)
        else:
            ends[where], at[where] = v, k
    out, k = [], at[-1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out


@pytest.mark.parametrize("kinds", [3, 12, 200])
def test_matched_places(monkeypatch, kinds):
    rng = np.random.default_rng(kinds)
    a, b = (rng.integers(0, kinds, 300).astype(np.uint32) for _ in range(2))
    calls = []
    monkeypatch.setattr(substring_dedup, "bisect_left", lambda x, v: calls.append(v) or bisect_left(x, v))
    i, j = substring_dedup._matched(a, b, -300, 300)
    pairs = [(x, y) for y in range(300) for x in range(299, -1, -1) if a[x] == b[y]]
    # as long as a longest chain
    assert len(i) == len(by_one([x for x, _ in pairs])) and (a[i] == b[j]).all()
    assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
    assert len(calls) <= 8 * 300


def test_chains_are_those_found_place_by_place():
    rng = np.random.default_rng(5)
    for n, width in ((1, 1), (40, 2), (40, 30), (200, 9)):
        at = np.repeat(np.arange(n), rng.integers(1, width + 1, n))
        x = np.concatenate([np.sort(rng.choice(60, (at == k).sum(), replace=False))[::-1] for k in range(n)])
        assert substring_dedup._rising(x, at) == by_one(x.tolist())
