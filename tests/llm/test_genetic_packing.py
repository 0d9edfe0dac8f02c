"""The genetic algorithm of the packing operator: it runs, keeps every piece, and beats best-fit decreasing where that misses the bound."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from octaspark.llm import packing
from octaspark.llm.packing import Grouping


def decreasing(sizes, capacity):
    return len(Grouping.of(sizes, np.argsort(-sizes, kind="stable"), capacity).room)


def hard(rng, n):
    """Triplets of pieces that fill sequences exactly; best-fit decreasing misses most."""
    a, b = rng.integers(1100, 1700, n), rng.integers(1100, 1290, n)
    return np.r_[a, b, 4096 - a - b]


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 200)
    one, two = (Grouping.of(sizes, rng.permutation(200), 100) for _ in range(2))
    for _ in range(20):
        child = packing.crossover(sizes, one, two, rng, 100)
        assert (100 - child.room == np.bincount(child.number, sizes, len(child.room))).all() and child.room.min() >= 0 and child.number.min() >= 0
        one, two = two, child


@pytest.mark.parametrize("kind", ["triplets", "uniform"])
def test_generations_gain(kind):
    rng = np.random.default_rng(5)
    sizes = hard(rng, 400) if kind == "triplets" else rng.integers(820, 2048, 1200)
    start, _ = packing.evolve(sizes, [], np.random.default_rng(1), 4096, generations=0)
    people, born = packing.evolve(sizes, [], np.random.default_rng(1), 4096, generations=16)
    assert born == 16 and len(people[0].room) < len(start[0].room) and len(people[0].room) < decreasing(sizes, 4096)


@pytest.mark.parametrize("last", [False, True])
def test_guests_take_part(last):
    """An elite that migrated is among the population that breeds: without generations, the best is the guest itself."""
    rng = np.random.default_rng(8)
    sizes = hard(rng, 100)
    people = [Grouping.of(sizes, rng.permutation(len(sizes)), 4096) for _ in range(packing.POPULATION)]
    guest = np.tile(np.arange(100), 3)  # the triplets themselves: 100 full sequences
    frame = pd.DataFrame({"item": np.arange(len(sizes)), "length": sizes, "cell": 0, "people": list(np.stack([p.number for p in people], 1).astype(np.int32)), "guest": guest.astype(np.int32), "island": 0})
    got = packing._island(4096, 1, last, generations=0)((0, 0), frame)
    assert min(len(p.room) for p in people) > 100 and decreasing(sizes, 4096) > 100
    assert got["bins"].unique().tolist() == [100] and len(got["people"].iloc[0]) == packing.POPULATION


def test_one_cell_and_levels(spark):
    rng = np.random.default_rng(6)
    sizes = hard(rng, 300)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, length long")
    for cell in (4096, 256):
        log = []
        got = packing.solve(items, cell=cell, log=log).join(items, "item")
        bins = got.groupBy("level", "cell", "bin").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).collect()
        assert sum(b.k for b in bins) == len(sizes) and max(b.n for b in bins) <= 4096
        # every island of every epoch bred all its generations, and the second epoch goes on from the first
        assert log[0]["generations"] == log[0]["cells"] * packing.ISLANDS * packing.EPOCHS * packing.GENERATIONS
        assert all(x["bins_1"] <= x["bins_0"] for x in log) and log[-1]["cells"] == 1 and len(log) <= 5
        if cell == 4096:
            assert len(bins) < decreasing(sizes, 4096)


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "same text", 3), (3, "same text", 3), (4, "long " * 9000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumn("item", F.lit("x")).withColumn("cell", F.lit(0))
    got = packing.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id != 4) == [(0, 1), (0, 1), (3, got[[r.doc_id for r in got].index(3)].length)] + [(3, got[[r.doc_id for r in got].index(3)].length)]
    assert [r.length for r in sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)][:-1] == [4096] * (len([r for r in got if r.doc_id == 4]) - 1)
