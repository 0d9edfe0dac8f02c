"""Connected components of an edge table, by contraction in rounds.

In each round every node points to the neighbour (or itself) with the least
rank, and the edges are drawn between what their ends point to. In the first
round the rank is the node itself, so stars around their least node, as the
operators draw them, are done at once. Then it is a hash that changes by round,
so chains shrink as fast as stars; rounds grow with the logarithm of the number
of nodes. When REST edges or fewer are left, one task finds what they connect:
a round has several stages, each of which takes its time however few rows it
has. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, drop, save

#: Edges that one task connects (4 MB of them); more are contracted in a round first.
REST = 250_000


def _rest(batches):
    """The least node that each end of all edges (a, b) is connected with."""
    edges = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not edges:
        return
    a, b = (np.concatenate(x) for x in zip(*edges))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "to"])


def components(edges: DataFrame, clean: bool = False) -> DataFrame:
    """(node, component) for every end of the edges (a, b), two longs; component is a node of it.

    ``clean`` edges are a saved table without loops and repeats.
    """
    spark = edges.sparkSession
    paths, steps, turn = [], [], 0
    if not clean:
        edges, path = save(edges.select("a", "b").filter("a <> b").distinct())
        paths.append(path)
    while left := edges.limit(REST + 1).count():
        if left <= REST:
            to, path = save(arrow_map(edges.select("a", "b").repartition(1), _rest, "node long, to long"))
            paths.append(path)
            steps.append(to)
            break
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        to = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        to, path = save(to.select("node", F.least(rank("node"), "near")["v"].alias("to")))
        paths.append(path)
        steps.append(to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges, path = save(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        paths.append(path)
        turn += 1
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out, _ = save(out)
    drop(spark, *paths)
    return out
