"""Connected components: few stages for long chains, the same whether rounds or one task find them."""

import random

import pytest

from octaspark.llm import components as module


def by_hand(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def named(spark, edges):
    """Components by their least node; the number of nodes must be that of the rows."""
    rows = module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    least = {}
    for r in rows:
        least[r.component] = min(r.node, least.get(r.component, r.node))
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: least[r.component] for r in rows}


rnd = random.Random(4)
CHAIN = [(k, k + 1) for k in range(3000)]
EDGES = CHAIN + [(5, 5)] + [(10_000 + rnd.randrange(900), 10_000 + rnd.randrange(900)) for _ in range(600)] + [(20_000 + k, 29_999) for k in range(50)]


@pytest.mark.parametrize("rest", [module.REST, 100, 0])
def test_components(spark, monkeypatch, rest):
    monkeypatch.setattr(module, "REST", rest)
    assert named(spark, EDGES) == by_hand(EDGES)


def test_a_chain_takes_few_tables(spark, monkeypatch):
    """Each table is a few stages; by rounds alone this chain took one for each of its many rounds and two more."""
    saved = []
    monkeypatch.setattr(module, "save", lambda df, save=module.save: saved.append(1) or save(df))
    assert named(spark, CHAIN) == {k: 0 for k in range(3001)}
    assert len(saved) <= 3
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0
