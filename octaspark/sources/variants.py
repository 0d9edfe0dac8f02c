"""The derived corpus: documents re-encoded, a row for each text and encoding that can hold it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import stream
from ..schemas import INPUT_CAP

LABELS = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-16", "utf-32-le", "utf-32-be", "iso8859-1", "cp1252", "cp437", "mac_roman")


def unicode_variants(docs: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, label, raw) in the Unicode encodings, or in the named ones of them, by Catalyst expressions alone."""
    text = F.coalesce("text", F.lit(""))
    be = F.encode(text, "UTF-32")
    forms = {
        "utf-8": text.cast("binary"),
        "utf-8-sig": F.concat(F.expr("X'EFBBBF'"), text.cast("binary")),
        "utf-16-le": F.encode(text, "UTF-16LE"),
        "utf-16-be": F.encode(text, "UTF-16BE"),
        "utf-16": F.concat(F.expr("X'FFFE'"), F.encode(text, "UTF-16LE")),
        "utf-32-be": be,
        "utf-32-le": F.unhex(F.regexp_replace(F.hex(be), "(..)(..)(..)(..)", "$4$3$2$1")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("raw")) for k, v in forms.items() if labels is None or k in labels]))
    return docs.select("doc_id", rows.alias("v")).select("doc_id", "v.label", "v.raw")


def codec_variants(docs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(doc_id, label, raw) in any of Python's encodings; a text that one can't hold has no row there."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, names, raws = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for label in labels:
                    try:
                        raw = (t or "").encode(label)
                    except UnicodeEncodeError:
                        continue
                    ids.append(i)
                    names.append(label)
                    raws.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(raws, pa.binary())], names=["doc_id", "label", "raw"])

    return stream(docs.select("doc_id", "text"), run, f"doc_id {kind}, label string, raw binary")


def binary_files(spark, path: str, cap: int = INPUT_CAP, glob: str | None = None) -> DataFrame:
    """(path, raw) of a folder's files; a file above the cap is an error when it is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", F.when(F.col("length") > cap, F.raise_error(F.concat(F.lit("file above the input cap: "), "path"))).otherwise(F.col("content")).alias("raw"))
