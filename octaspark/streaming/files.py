"""Streams of files and of chunks, for the stateless operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship
from ..operators import codecs, detect
from ..operators.model import Language, Linear
from ..schemas import INPUT_CAP

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of a folder's files as they come; one above the cap is left to the operators, which give it a reason."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("raw"))


def detect_files(spark: SparkSession, path: str, out: str, checkpoint: str, model: Linear, language: Language | None = None) -> StreamingQuery:
    """Detect every new file once and append what was found to a Parquet folder; ends when all files that are there are done."""
    found = detect.detect(stream_files(spark, path), model, language).select("path", "detection.*")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def reassemble(chunks: DataFrame) -> DataFrame:
    """(key, raw, state) of streamed chunks (key, number, last, part): a row for a key whenever chunks come.

    ``state`` is incomplete while more bytes could change what the first ones
    say (a signature not yet whole) or chunks are missing, then whole; with
    whole the object is given and its state forgotten. Objects above the input
    cap are given up: state is too_large, and raw is null.
    """
    ship(chunks.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, parts, last = state.get if state.exists else ([], [], -1)
        numbers, parts = list(numbers), [bytes(p) for p in parts]
        for frame in frames:
            for n, end, part in zip(frame["number"], frame["last"], frame["part"]):
                if n not in numbers:
                    numbers.append(int(n))
                    parts.append(bytes(part))
                last = int(n) if end else last
        order = sorted(range(len(numbers)), key=numbers.__getitem__)
        raw = b"".join(parts[i] for i in order)
        done = last >= 0 and sorted(numbers) == list(range(last + 1))
        large = len(raw) > INPUT_CAP
        if done or large:
            state.remove()
        else:
            state.update((numbers, parts, last))
        told = "too_large" if large else "whole" if done else "incomplete"
        first = codecs.signature(raw, done)[0] if 0 in numbers else None
        yield pd.DataFrame({"key": [key[0]], "raw": [raw if done and not large else None], "state": [told], "bom_encoding": [first]})

    return chunks.groupBy("key").applyInPandasWithState(
        run, "key string, raw binary, state string, bom_encoding string", "numbers array<int>, parts array<binary>, last int", "append", GroupStateTimeout.NoTimeout
    )
