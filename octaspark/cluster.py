"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the batches that go to Python workers, for sessions that set no limit: Spark's own is a number of rows.
BATCH_BYTES = 6 << 20
#: Bytes and rows of the pieces of a batch that a worker has in hand at a time.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2048
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per Spark context, as a zip of its sources."""
    sc = spark.sparkContext
    if not getattr(sc, "_octaspark_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="octaspark-")), "octaspark.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith((".py", ".json")):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("octaspark", os.path.relpath(full, root)))
        sc.addPyFile(path)
        sc._octaspark_shipped = True
    return spark


def pieces(batches, most: int = PIECE_BYTES):
    """The batches cut to pieces of ``most`` bytes and PIECE_ROWS rows at most; a longer row is a piece of its own."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(batch.num_rows - at, PIECE_ROWS)
            while n > 1 and (size := batch.slice(at, n).nbytes) > most:
                n = max(1, min(n // 2, n * most // size))
            yield batch.slice(at, n)
            at += n


def stream(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers and ``fn`` fed by :func:`pieces`, so what a worker holds depends neither on rows nor on tables."""
    spark = ship(df.sparkSession)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: fn(pieces(batches)), schema)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that ``spark.checkpoint.dir`` names, and read again; in local mode a temporary one serves if it is unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="octaspark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/octaspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
