"""Manifests and corpora of labelled files: scans, rules, writers.

A manifest is JSON, one object a line: path, encoding, group, split and
optionally sha256 and prefix_sha256; paths are relative to its folder. Files are
read by ``binaryFile`` and joined by path, rules are filters and aggregates, and
only the first broken rule comes to the driver.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship, stream
from ..functions import bytesql as B
from ..operators import codecs as c
from ..operators import corpus
from ..schemas import PREFIX

SCHEMA = "path string, encoding string, group string, split string, sha256 string, prefix_sha256 string"
#: What each kind of manifest allows and asks for.
KINDS = {
    "training": {"splits": ("train", "validation"), "codec": True, "digests": True, "duplicates": "drop"},
    "legacy": {"splits": ("train", "validation"), "codec": False, "digests": False, "duplicates": "keep"},
    "evaluation": {"splits": ("train", "validation", "test"), "codec": True, "digests": False, "duplicates": "error"},
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, the fields, and whether the line is JSON; blank lines are left out."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    own = text.filter(F.trim("line") != "").select((F.col("k") + 1).alias("line_no"), F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), F.col("line"))
    return own.select("line_no", "r.*", F.expr("try_parse_json(line)").isNotNull().alias("json"))


def _decodes(df: DataFrame) -> DataFrame:
    """``df`` with known (the codec exists), canonical and decodes, from raw and encoding."""
    names = df.columns

    def run(batches):
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("encoding")).to_pylist()
            raws = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            canon = [c.canonical(x or "") for x in labels]
            reads = [x is not None and r is not None and c.strict(r, x) is not None for x, r in zip(canon, raws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(canon, pa.string()), pa.array(reads, pa.bool_())], names=[*names, "canonical", "decodes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return stream(df, run, f"{kinds}, canonical string, decodes boolean")


def judge(rows: DataFrame, kind: str = "training") -> DataFrame:
    """Rows (line_no, fields, raw, sha, prefix_sha, canonical, decodes) with ``rule``, the first that each breaks, or null.

    Groups are judged before duplicates go, so that a duplicate can show a leak.
    """
    own = KINDS[kind]
    before = lambda *by: Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    first = lambda x, *by: F.first(x).over(before(*by))
    rules = [("invalid JSON", ~F.col("json"))]
    rules += [(f"missing {x}", blank(x)) for x in ("path", "encoding", "group", "split")]
    rules += [("unsupported split", ~F.col("split").isin(*own["splits"])), ("path escapes manifest directory", F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)"))]
    rules += [("missing or empty input", F.col("raw").isNull()), ("empty input", F.length("raw") == 0)]
    if own["digests"]:
        rules += [(f"{x} mismatch", F.col(x).isNotNull() & (F.col(x) != F.col(y))) for x, y in (("sha256", "sha"), ("prefix_sha256", "prefix_sha"))]
    if own["codec"]:
        rules += [("unknown codec", F.col("canonical").isNull())]
    rules += [("label does not decode bytes", ~F.col("decodes")), ("source-group leakage", first("split", "group") != F.col("split"))]
    label = F.col("canonical") if kind == "evaluation" else F.col("encoding")
    if own["duplicates"] == "drop":
        rules += [("duplicate bytes cross labels/splits", (first("encoding", "sha") != label) | (first("split", "sha") != F.col("split")))]
    elif own["duplicates"] == "error":
        rules += [("duplicated bytes across splits", first("split", "sha") != F.col("split")), ("conflicting labels for identical bytes", first("canonical", "sha") != label), ("duplicated evaluation content", first("line_no", "sha").isNotNull())]
    rule = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        rule = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(rule)
    return rows.withColumn("rule", rule).withColumn("copy", first("line_no", "sha").isNotNull())


def read(spark: SparkSession, path: str, kind: str = "training", strict: bool = True) -> DataFrame:
    """The accepted rows of a manifest: line_no, path, encoding, group, split, sha256, raw.

    The first broken rule raises ValueError; without ``strict`` all rows come back, with their rules.
    """
    folder = path.rsplit("/", 1)[0]
    listed = lines(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    at = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    files = files.select(F.substring(at, len(root) + 2, 1 << 20).alias("file"), F.col("content").alias("raw"))
    rows = listed.join(files, listed["path"] == files["file"], "left").drop("file")
    rows = _decodes(rows.withColumn("sha", F.sha2("raw", 256)).withColumn("prefix_sha", F.sha2(B.prefix(F.col("raw")), 256)))
    rows = judge(rows, kind)
    if not strict:
        return rows
    if bad := rows.filter("rule IS NOT NULL").orderBy("line_no").select("line_no", "rule").first():
        raise ValueError(f"line {bad.line_no}: {bad.rule}")
    if KINDS[kind]["duplicates"] == "drop":
        rows = rows.filter(~F.col("copy"))
    if kind != "evaluation":
        seen = {r.split: set(r.labels) for r in rows.groupBy("split").agg(F.collect_set("encoding").alias("labels")).collect()}  # labels are few
        if set(seen) != {"train", "validation"}:
            raise ValueError("both train and validation records required")
        if len(seen["train"]) < 2:
            raise ValueError("need two training labels or more")
        if kind == "training" and seen["validation"] - seen["train"]:
            raise ValueError("validation label absent from training")
    label = F.col("canonical") if kind == "evaluation" else F.col("encoding")
    return rows.select("line_no", "path", label.alias("encoding"), "group", "split", F.col("sha").alias("sha256"), "raw")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """A corpus of folders named by encoding: path, encoding, group, fold, digests, raw.

    Empty and undecodable files are left out, and of equal prefixes all but the first path.
    """
    files = ship(spark).read.format("binaryFile").load(f"{root}/*/*")
    parts = F.split("path", "/")
    rows = files.filter("length > 0").select(
        F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("path"), F.element_at(parts, -2).alias("dir"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), F.col("content").alias("raw"),
    )
    rows = rows.join(F.broadcast(corpus.directory_labels(rows.select("dir").distinct())), "dir").withColumnRenamed("label", "encoding")  # a row for each folder
    rows = _decodes(rows).filter("decodes")
    d = corpus.digests(F.col("raw"))
    rows = rows.select("path", "encoding", B.source_group(F.col("stem")).alias("group"), d["sha256"].alias("sha256"), d["prefix_sha256"].alias("prefix_sha256"), "raw")
    return corpus.first_seen(rows, ["prefix_sha256"], ["path"]).withColumn("fold", B.fold3(F.col("group")))


def zipped(files: DataFrame, members: int = 10_000, total: int = 500 << 20, least: int = 1, most: int = 6 << 20) -> DataFrame:
    """Members of ZIP archives (path, raw), in order of their names: name, group, raw and the reason why one is left out.

    An archive above the bounds, or one that can't be read, gives one row with a reason.
    """
    own = files.select("path", "raw")

    def open_(path, raw):
        try:
            z = zipfile.ZipFile(io.BytesIO(raw or b""))
        except zipfile.BadZipFile:
            return [(path, None, None, None, "not_an_archive")]
        infos = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
        if len(infos) > members or sum(i.file_size for i in infos) > total:
            return [(path, None, None, None, "archive_above_bounds")]
        seen, out = set(), []
        for i in infos:
            parts = i.filename.split("/")
            if len(parts) != 3 or parts[0] != "corpus" or ".." in parts:
                out.append((path, i.filename, None, None, "unexpected_path"))
            elif not least <= i.file_size <= most:
                out.append((path, i.filename, parts[1], None, "size"))
            elif (data := z.read(i)) in seen:
                out.append((path, i.filename, parts[1], None, "duplicate"))
            else:
                seen.add(data)
                out.append((path, i.filename, parts[1], data, None))
        return out

    def run(batches):
        for batch in batches:
            for p, r in zip(*(x.to_pylist() for x in batch.columns)):
                cols = list(zip(*open_(p, r))) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == 3 else pa.string()) for k, v in enumerate(cols)], names=["path", "name", "group", "raw", "reason"])

    return stream(own, run, "path string, name string, `group` string, raw binary, reason string")


def write(rows: DataFrame, path: str, order: str = "path") -> None:
    """A manifest or ledger as JSON lines in total order; one file, since readers take it line by line."""
    rows.repartitionByRange(1, order).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(rows: DataFrame, path: str) -> str:
    """A small result (a report) as sorted, indented JSON text, written to a file of the driver."""
    import json

    text = json.dumps([r.asDict(True) for r in rows.collect()], indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return text


__all__ = ["KINDS", "PREFIX", "directory", "judge", "lines", "read", "report", "write", "zipped"]
