"""What the training-data operators share: scratch tables, size-checked joins, text slices.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, which every
executor of a cluster can read; a lost executor therefore costs only a re-read.
"""

from __future__ import annotations

import ctypes
import platform
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Rows of a key set that may be broadcast (a few MB); larger sets are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 2 << 20
#: Bytes of the batches that go to Python workers, for sessions that set no limit: Spark's own is a number of rows.
BATCH_BYTES = 6 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode without one, a temporary folder is set as checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="octaspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def save(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again; the path is for :func:`drop`."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/octaspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does when the driver collects garbage, which may be long after."""
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Let the executors collect garbage and return the heap that is free then: a JVM keeps what its largest stage took, beside the Python workers of the next.

    A task for each core, so every executor that is up has some; collections asked for at once are done once.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, held: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (it must be cheap to count), else as it is.

    ``held`` is the number of elements of a row's array; a broadcast holds at most four times ``rows`` of them.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    return df if held is not None and (df.agg(F.sum(held)).first()[0] or 0) > 4 * rows else F.broadcast(df)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Pieces of a batch with about ``most`` bytes of text at most; a longer text is a piece of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    if len(texts) == 0:
        return
    give_back()
    size = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage holds on to narrows the next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> pa.Array:
    """A string column with empty texts in place of nulls."""
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (one more at the end)."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hide(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with all columns but those to keep under names that no operator uses; :func:`show` gives the names back."""
    return df.toDF(*[c if c in keep else f"octa_c{i}" for i, c in enumerate(df.columns)])


def show(df: DataFrame, like: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``like``, hidden by :func:`hide`, under their own names, and then the other columns of ``df``."""
    own = hide(like, *keep).columns
    return df.select(*[F.col(f"`{h}`").alias(c) for h, c in zip(own, like.columns)], *[c for c in df.columns if c not in own])


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; one that is missing is null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names])


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers and, unless the session has its own limit, batches of BATCH_BYTES."""
    spark = ship(df.sparkSession)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)
