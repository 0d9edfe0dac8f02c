"""Evaluation: paired outcomes, grouping sets, exact percentiles, macro averages, confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import numbered


def paired(df: DataFrame, by: list[str], old: str, new: str) -> DataFrame:
    """Counts of rows that the new rule helps, harms or leaves."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(old)).alias("old_correct"), F.count_if(F.col(new)).alias("new_correct"),
        F.count_if(F.col(new) & ~F.col(old)).alias("helped"), F.count_if(F.col(old) & ~F.col(new)).alias("harmed"), F.count_if(F.col(old) == F.col(new)).alias("ties"),
    )


def by_sets(df: DataFrame, first: str, second: str, outcome: str) -> DataFrame:
    """Counts by either column and in all, in one pass."""
    return df.groupingSets([[F.col(first)], [F.col(second)], []], first, second).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome)).alias("hits"), F.grouping_id().cast("long").alias("level")
    )


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median (mean of the middle two) and the floor-index 95th percentile, exactly.

    Values are counted first, so what a group needs is its distinct values with
    counts; running sums come range by range, and the rows at the wanted ranks
    are picked by comparison.
    """
    own = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    own = numbered(own, value, by, "from", "c").withColumn("to", F.col("from") + F.col("c"))
    size = own.groupBy(by).agg(F.sum("c").alias("n"))
    own = own.join(size, by)
    n = F.col("n")
    at = lambda k: F.max(F.when((F.col("from") <= k) & (F.col("to") > k), F.col(value)))
    return own.groupBy(by, "n").agg(
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.floor(F.lit(0.95) * (n - 1).cast("double"))).alias("p95"),
    )


def macro(df: DataFrame, by: str, outcome: str) -> DataFrame:
    """The mean of the groups' rates, in percent."""
    per = df.groupBy(by).agg((F.count_if(F.col(outcome)) / F.count(F.lit(1))).alias("rate"))
    return per.agg(F.round(F.avg("rate") * 100, 2).alias("macro"), F.count(F.lit(1)).alias("groups"))


def confusion(df: DataFrame, truth: str, guess: str, top: int = 12) -> DataFrame:
    """The most frequent wrong pairs."""
    miss = df.filter(~F.col(truth).eqNullSafe(F.col(guess))).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return miss.orderBy(F.desc("n"), truth, guess).limit(top)


def mismatch(text, truth):
    """How a text differs from the truth."""
    bare = lambda c: F.regexp_replace(c, "^﻿+", "")
    plain = lambda c: F.regexp_replace(bare(c), "\r\n?", "\n")
    return (
        F.when(text.isNull(), "no_decoded_text").when(text == truth, "correct").when(bare(text) == bare(truth), "bom_only")
        .when(plain(text) == plain(truth), "newline_only").otherwise("different_text")
    )


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose fields differ between two results, and rows on one side only."""
    fields = [c for c in left.columns if c != key]
    both = left.alias("a").join(right.alias("b"), key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    return both.select(key, changed.alias("fields")).filter(F.size("fields") > 0)


def changed(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, field) of everything that differs between a golden result and a new one; numbers may differ by ``tolerance``, a missing row is the field ``*``."""
    fields = [f for f in left.columns if f != key]
    kinds = dict(left.dtypes)
    a, b = left.withColumn("octa_a", F.lit(True)).alias("a"), right.withColumn("octa_b", F.lit(True)).alias("b")
    both = a.join(b, key, "full_outer")

    def differs(f: str):
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        return ~x.eqNullSafe(y) & ~F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kinds[f] in ("double", "float") else ~x.eqNullSafe(y)

    lost = F.col("octa_a").isNull() | F.col("octa_b").isNull()
    every = F.when(lost, F.array(F.lit("*"))).otherwise(F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in fields])))
    return both.select(key, F.explode(every).alias("field"))


def tensor_differences(df: DataFrame, old: str, new: str, by: list[str] | None = None) -> DataFrame:
    """Counts of changes by size, sign flips, and the largest, mean and root mean square difference."""
    d = F.abs(F.col(old) - F.col(new))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(old) != F.col(new)).alias("changed"), F.count_if(d > 1e-6).alias("above_1e6"), F.count_if(d > 1e-4).alias("above_1e4"),
        F.count_if(d > 1e-2).alias("above_1e2"), F.count_if(F.signum(F.col(old)) != F.signum(F.col(new))).alias("flips"),
        F.max(d).alias("largest"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"),
    )


def mode(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen. Counted before it is shuffled."""
    per = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return per.groupBy(by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(by, F.col(f"m.{value}").alias("mode"), "m.n")


def outcome(accepted, correct):
    """correct, silent_wrong or abstained."""
    return F.when(~F.coalesce(accepted, F.lit(False)), "abstained").when(F.coalesce(correct, F.lit(False)), "correct").otherwise("silent_wrong")


def argmax(values):
    """The place (from 0) of an array's largest value, the first among equals; null for an empty one."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def softmax(df: DataFrame, by: str, score: str) -> DataFrame:
    """``df`` with p, the share of exp(score) in its group, shifted by the group's largest score."""
    own = Window.partitionBy(by)
    e = F.exp(F.col(score) - F.max(score).over(own))
    return df.withColumn("octa_e", e).withColumn("p", F.col("octa_e") / F.sum("octa_e").over(own)).drop("octa_e")


def replay(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(fact, expected, actual) of all facts (fact, value) that differ or are missing on a side: a gate passes if there are none."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "fact", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select("fact", "expected", "actual")
