"""Corpus governance: fingerprints, first-seen dedup, folds, windows, overlap screens, manifests, splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import saved, stream
from ..functions import bytesql as B
from ..schemas import OVERLAP, PREFIX, RESIDUAL


def digests(raw: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(raw, 256), "prefix_sha256": F.sha2(B.prefix(raw), 256)}


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum of the order columns rather than a window: it is combined before the
    shuffle, so a key that holds a third of all rows sends one row for each task.
    """
    place = F.struct(*order)
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), place).alias("r"))
    return first.select("r.*")


def windows(df: DataFrame, column: str, size: int = 8192, least: int = 128) -> DataFrame:
    """Three windows of each object: from the start, a third and two thirds; too short and plain ASCII ones are left out."""
    n = F.length(column)
    rows = df.select("*", F.posexplode(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int"))).alias("window", "at"))
    rows = rows.withColumn("part", F.substr(F.col(column), F.col("at") + 1, F.lit(size)))
    return rows.filter((F.length("part") >= least) & (B.high_count(F.col("part")) > 0))


def overlap(held: DataFrame, training: DataFrame, key: str, column: str, shared: int = OVERLAP["shared"]) -> DataFrame:
    """(key, other, n): pairs of a held-out and a training object that share blocks, ``shared`` or more of them.

    Equal objects are joined once: each side is first reduced to its distinct
    sets of blocks, and pairs are told for the copies only at the end.
    """
    sides = []
    for df, name in ((held, key), (training, "other")):
        blocks = F.array_sort(B.blocks(F.col(column), OVERLAP["block"], OVERLAP["step"]))
        sides.append(df.select(F.col(key).alias(name), blocks.alias("b")).filter(F.size("b") >= shared).withColumn("set", F.xxhash64(F.col("b"), F.size("b"))))
    one, two = (s.groupBy("set").agg(F.any_value("b").alias("b")).select(F.col("set").alias(n), F.explode("b").alias("h")) for s, n in zip(sides, ("x", "y")))
    alike = one.join(two, "h").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shared)
    return alike.join(sides[0].select(key, F.col("set").alias("x")), "x").join(sides[1].select("other", F.col("set").alias("y")), "y").select(key, "other", "n")


def residual(df: DataFrame, label: str, guess: str, order: str, drop: float = RESIDUAL["drop"], anchors: int = RESIDUAL["anchors"]) -> DataFrame:
    """Rows that structure doesn't already decide: right guesses go, in order, up to a share of each label."""
    hit = F.coalesce(F.col(guess) == F.col(label), F.lit(False))
    keys = saved(df.select(label, order, hit.alias("octa_hit")))  # guesses may be dear: they are made once
    size = keys.groupBy(label).agg(F.count(F.lit(1)).alias("octa_n"))
    limit = F.least(F.col("octa_n") - anchors, F.floor(F.col("octa_n").cast("double") * F.lit(float(drop))))
    # only the keys of right guesses are numbered; those beyond the limit stay
    place = numbered(keys.filter("octa_hit").select(label, order), order, label, "octa_place").join(size.select(label, limit.alias("octa_limit")), label)
    gone = place.filter(F.col("octa_place") < F.col("octa_limit")).select(label, order)
    return df.join(gone, [label, order], "left_anti")


def structural_guess(raw: Column) -> Column:
    """What signatures and NUL parity alone say."""
    bom = B.bom_encoding(raw)
    generic = F.when(bom.startswith("utf-16"), "utf-16").when(bom.startswith("utf-32"), "utf-32").otherwise(bom)
    return F.coalesce(generic, B.utf16_parity(raw))


def violations(manifest: DataFrame) -> DataFrame:
    """(rule, key, n) of a manifest (path, encoding, split, group, sha256): every broken rule, aggregated before it is shuffled."""
    text = ["path", "encoding", "split", "group"]
    blank = F.explode(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in text])).alias("key")
    empty = manifest.select(blank).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("empty_field").alias("rule"), "key", "n")
    split = manifest.filter(~F.col("split").isin("train", "validation", "test")).groupBy(F.col("split").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_split").alias("rule"), "key", "n")
    leave = manifest.filter(F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)")).groupBy(F.col("path").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("path_escapes").alias("rule"), "key", "n")
    leak = manifest.groupBy(F.col("group").alias("key")).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("group_leak").alias("rule"), "key", "n")
    twice = manifest.groupBy(F.col("sha256").alias("key")).agg(F.count_distinct("encoding", "split").alias("n")).filter("n > 1").select(F.lit("duplicate_conflict").alias("rule"), "key", "n")
    return empty.unionByName(split).unionByName(leave).unionByName(leak).unionByName(twice)


def content_fingerprint(manifest: DataFrame, order: str) -> DataFrame:
    """One digest of all rows in order: rows are digested first, then their digests (64 characters each) in order."""
    row = F.sha2(F.concat_ws("\x00", "sha256", "encoding", "split", "group").cast("binary"), 256)
    return manifest.select(F.col(order).alias("o"), row.alias("d")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: str, by: str | None = None, place: str = "place", weight: str | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in the given order (within each value of ``by``), or the sum of ``weight`` before it.

    Two levels: rows are sorted into ranges, each range is numbered by itself,
    and what the ranges before hold is added. So neither one group nor the
    whole table is sorted by one task. Keep wide columns out: rows are written once.
    """
    one = F.col(weight) if weight else F.lit(1)
    key = [by] if by else []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(parts, *key, order).withColumn("octa_range", F.spark_partition_id()))
    totals = ranged.groupBy("octa_range", *key).agg(F.sum(one).alias("octa_n"))
    before = Window.partitionBy(*key).orderBy("octa_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    totals = totals.select("octa_range", *key, F.coalesce(F.sum("octa_n").over(before), F.lit(0)).alias("octa_base"))
    own = Window.partitionBy("octa_range", *key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("octa_own", F.coalesce(F.sum(one).over(own), F.lit(0))).join(totals, ["octa_range", *key])
    return out.withColumn(place, F.col("octa_base") + F.col("octa_own")).select(*df.columns, place)


def round_robin(df: DataFrame, strata: str, group: str, folds: int = 5) -> DataFrame:
    """``df`` with the fold of its group: the k-th group of each stratum goes to fold k mod ``folds``, whole."""
    groups = numbered(df.select(strata, group).distinct(), group, strata, "fold")
    return df.join(groups.withColumn("fold", (F.col("fold") % folds).cast("int")), [strata, group])


def balanced_sample(df: DataFrame, by: str, key: Column, n: int = 8) -> DataFrame:
    """The ``n`` rows of each group with the least keys."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(key))).filter(F.col("rank") <= n)


def catalog(lines: DataFrame) -> DataFrame:
    """(path, source, provenance) of a Markdown catalog (line_no, text): a heading names a folder, table rows below it its files."""
    heading = F.regexp_extract("text", r"^#+\s+`?([^`]+?)/?`?\s*$", 1)
    own = lines.withColumn("dir", F.when(F.col("text").rlike(r"^#"), heading))
    own = own.withColumn("dir", F.last("dir", ignorenulls=True).over(Window.orderBy("line_no")))  # a catalog is one document
    cells = F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|")
    row = own.filter(F.col("text").rlike(r"^\|\s*`")).withColumn("c", cells)
    return row.select(F.concat_ws("/", "dir", F.regexp_extract(F.col("c")[0], "`([^`]+)`", 1)).alias("path"), F.trim(F.col("c")[1]).alias("source"), F.trim(F.col("c")[2]).alias("provenance"))


# Endings of folder names that tell a language, not an encoding.
ISO_CODES = (
    "ar be bg br cs cy da de el en eo es et fa fi fr ga gd he hr hu id is it ja kk ko lt lv mk ms mt nl no pl pt ro ru sk sl sr sv tg th tr uk ur vi zh"
).split()
LANGUAGES = (
    "arabic belarusian breton bulgarian chinese croatian czech danish dutch english esperanto estonian farsi finnish french gaelic german greek hebrew "
    "hungarian icelandic indonesian irish italian japanese kazakh korean latvian lithuanian macedonian malay maltese norwegian polish portuguese romanian "
    "russian serbian slovak slovene spanish swedish tajik thai turkish ukrainian urdu vietnamese welsh"
).split()


def aliases(names: list[str]) -> dict[str, str]:
    """Names that Python has a codec for, with the codec's own name."""
    from .codecs import canonical

    return {n: found for n in names if (found := canonical(n))}


def directory_labels(dirs: DataFrame) -> DataFrame:
    """(dir, label) of folders (dir) whose name, less a language's ending, is a codec; folders are few."""
    names = [r.dir for r in dirs.distinct().collect()]
    stems = {n: n.rpartition("-") for n in names}
    known = aliases([*names, *(base for base, _, _ in stems.values())])
    out = []
    for n, (base, dash, end) in stems.items():
        plain = n in ("None", "None-None", "ascii") or not dash
        if label := known.get(base if not plain and (end in LANGUAGES or (end in ISO_CODES and base in known)) else n):
            out.append((n, label))
    return dirs.sparkSession.createDataFrame(out, "dir string, label string")


def length_windows(df: DataFrame, column: str, sizes: tuple[int, ...] = (256, 4096), least: int = 32) -> DataFrame:
    """Beginnings of each object by length, and the whole (size 0), cut back to whole UTF-8 characters; equal parts once, by doc_id and size."""
    rows = df.select("*", F.explode(F.array(*[F.lit(s) for s in (*sizes, 0)])).alias("size"))
    part = F.when(F.col("size") == 0, F.col(column)).otherwise(F.substr(F.col(column), F.lit(1), F.col("size")))
    rows = rows.withColumn("part", F.when(F.length(part) < F.length(column), B.trimmed(part)).otherwise(F.when(B.is_utf8(part), part)))
    rows = rows.filter(F.length("part") >= least).withColumn("sha256", F.sha2("part", 256))
    return first_seen(rows.drop(column), ["sha256"], ["doc_id", "size"])


def chunks(df: DataFrame, text: str, size: int = 1024, least: int = 128, non_ascii: int = 5) -> DataFrame:
    """Pieces of ``size`` characters (k from 0) that are long enough and not plain ASCII."""
    n = F.ceil(F.length(text) / size).cast("int")
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("k"))
    rows = rows.withColumn("chunk", F.substr(F.col(text), F.col("k") * size + 1, F.lit(size)))
    return rows.filter((F.length("chunk") >= least) & (F.length(F.regexp_replace("chunk", r"[\x00-\x7F]", "")) >= non_ascii))


def historical_fingerprint(manifest: DataFrame, order: str) -> DataFrame:
    """The digest of prefix digests, encodings and groups in order, each closed by a NUL; by its definition one row reads the manifest's short fields."""
    line = F.concat(*[F.concat(F.col(x), F.lit("\x00")) for x in ("prefix_sha256", "encoding", "group")])
    every = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return manifest.agg(F.sha2(F.array_join(F.transform(every, lambda x: x["l"]), "").cast("binary"), 256).alias("fingerprint"))


def canonical_fingerprint(manifest: DataFrame, order: str) -> DataFrame:
    """The digest of the accepted rows as compact JSON with sorted keys, in order."""
    line = F.to_json(F.struct("encoding", "group", "sha256", "split"))
    every = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(every, lambda x: x["l"]), ","), F.lit("]"))
    return manifest.agg(F.sha2(text.cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


_CHARSET = re.compile(rb"(?i)charset\s{0,8}=\s{0,8}[\"']?")
_TOKEN = re.compile(rb"[A-Za-z0-9_.:-]{0,64}")


def masked(raw: bytes) -> bytes:
    """As :func:`octaspark.functions.bytesql.mask_charset`, for the bytes of one object; a token may itself end in ``charset``."""
    out = None
    for m in _CHARSET.finditer(raw):
        a, b = _TOKEN.match(raw, m.end()).span()
        if b > a:
            out = out or bytearray(raw)
            out[a:b] = b"?" * (b - a)
    return bytes(out) if out else raw


def masked_windows(df: DataFrame, column: str, label: str, size: int = 8192, least: int = 128) -> DataFrame:
    """Three windows of each object whose charset declarations are masked, cut to whole characters of its label; equal parts once, the first by doc_id.

    ``label`` is the column that names each object's encoding.
    """
    import pyarrow as pa

    from .codecs import trim

    own = df.select("doc_id", label, F.col(column).cast("binary").alias("octa_raw"))
    told = lambda p: len(p) >= least and not p.isascii()

    def run(batches):
        for batch in batches:
            at, found, parts = [], [], []
            for k, (e, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                raw = masked(raw) if raw is not None else b""
                for w, begin in enumerate((0, len(raw) // 3, 2 * len(raw) // 3)):
                    part = raw[begin : begin + size]
                    if told(part) and told(part := trim(part, e, "both" if w else "end")):
                        at.append(k)
                        found.append(w)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int32())) for k in (0, 1)), pa.array(found, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", label, "window", "part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("octa_raw").schema)
    rows = stream(own, run, f"{kinds}, window int, part binary").withColumn("sha256", F.sha2("part", 256))
    return first_seen(rows, ["sha256"], ["doc_id", "window"])
