"""Sharding by jump consistent hash (Lamping and Veach), in SQL expressions only.

A row's shard is a function of its key and the number of shards; with one more
shard, rows move only into the new one. Integer keys are hashed as they are,
other keys by ``xxhash64``; a null key counts as 0.

Slots number the rows of a shard from 0 without gaps, in the order of doc_id
(null first; equal ones in any order). The numbering is in two levels: rows
are sorted into ranges, ranges are numbered, and each shard's count in the
ranges before is added. A range holds about as many rows as any other even if
one doc_id holds a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import save

#: The generator of the published algorithm: state * MULTIPLIER + 1 modulo 2 ** 64.
MULTIPLIER = 2862933555777941757
_LOW = (1 << 22) - 1
_C0, _C1, _C2 = MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44
#: Rows of a range of the slot numbering.
RANGE_ROWS = 1 << 20


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key.

    The 64-bit state is held as limbs of 22, 22 and 20 bits, so that products
    stay below 2 ** 63 and ANSI mode finds no overflow. A jump never lands
    before the next shard, so ``shards`` steps are always enough.
    """
    state = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        key.bitwiseAND(_LOW).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(_LOW).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
    )

    def step(a: Column, _: Column) -> Column:
        low = a["k0"] * _C0 + 1
        mid = F.shiftright(low, 22) + a["k0"] * _C1 + a["k1"] * _C0
        high = F.shiftright(mid, 22) + a["k0"] * _C2 + a["k1"] * _C1 + a["k2"] * _C0
        k0, k1, k2 = low.bitwiseAND(_LOW), mid.bitwiseAND(_LOW), high.bitwiseAND((1 << 20) - 1)
        top = F.shiftleft(k2, 11) + F.shiftright(k1, 11) + 1  # the upper 31 bits, plus one
        to = F.floor((a["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / top.cast("double")))
        on = a["j"] < shards
        return F.struct(
            F.when(on, a["j"]).otherwise(a["b"]).alias("b"), F.when(on, to).otherwise(a["j"]).alias("j"),
            k0.alias("k0"), k1.alias("k1"), k2.alias("k2"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda a: a["b"].cast("int"))


def key_of(df: DataFrame, column: str) -> Column:
    """A long key for any column."""
    kind = df.schema[column].dataType
    key = F.col(column).cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(column)
    return F.coalesce(key, F.lit(0).cast("long"))


def assign(df: DataFrame, shards: int, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``df`` with a shard column; nothing is shuffled."""
    return df.withColumn(shard, jump_hash(key_of(df, key), shards))


def slots(df: DataFrame, order: str = "doc_id", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard. Keep texts out of it: its rows are sorted and written once."""
    spark = df.sparkSession
    first, _ = save(df.withColumn("octa_pos", F.monotonically_increasing_id()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), first.count() // RANGE_ROWS + 1)
    ranged = first.repartitionByRange(ranges, F.col(order).asc_nulls_first(), "octa_pos").withColumn("octa_range", F.spark_partition_id())
    ranged, _ = save(ranged)
    counts = ranged.groupBy(shard, "octa_range").agg(F.count(F.lit(1)).alias("octa_n"))
    before = Window.partitionBy(shard).orderBy("octa_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("octa_base", F.coalesce(F.sum("octa_n").over(before), F.lit(0))).drop("octa_n")
    own = Window.partitionBy("octa_range", shard).orderBy(F.col(order).asc_nulls_first(), "octa_pos")
    out = ranged.withColumn("octa_rank", F.row_number().over(own)).join(counts, ["octa_range", shard])
    return out.withColumn(slot, F.col("octa_base") + F.col("octa_rank") - 1).select(*df.columns, slot)


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of each document, with its size (UTF-8 bytes plus 8) and what one more shard would do."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = key_of(docs, "doc_id")
    rows = docs.select(
        "doc_id",
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )
    return slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
