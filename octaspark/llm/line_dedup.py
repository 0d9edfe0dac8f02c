"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of non-blank lines (white space at both ends taken
off, hashed to 128 bits). Fingerprints:

* of each ``window`` consecutive pairs of lines, the pair with the least hash
  (the last of equal ones) is chosen, as in winnowing with k = 2; with the
  default window of 1 that is every pair, so every repeated pair is found;
* every line of ``long_line`` characters or more is chosen by itself.

A fingerprint is joined with its earliest occurrence (by doc_id, then text,
then line): a row for each occurrence, not for each pair. From there the match
is extended both ways along the same offset, as long as the lines agree, up to
the next match of the document on either side, which extends itself: so all
extensions of a document together look at each of its lines twice at most, and
a text of one line over and over costs no more than any other. (For
``min_lines`` above 2 the next match with the same source and offset counts, so
that runs are found whole; that bound on the work is given up there.) The later
run goes if it has ``min_lines`` lines or one line of ``long_line`` characters.
With a window of 1 every repeated run of two lines or more goes, since each of
its pairs is joined with the earliest equal one; a shorter line between unlike
neighbours stays, however often it occurs. With a wider window only runs of
``window`` + 1 lines whose fingerprints first occur together are certain. The
earliest occurrence always stays.

Lines are compared by 128 bits of two hashes: among 10 ** 12 lines one false
agreement has a chance of about 10 ** -15.

Blank lines (white space only) stay where they are. A null text stays null, an
empty one empty. Rows that share doc_id and text are one document and get equal
results; a null doc_id comes first. Within a document, an earlier run counts as
well. Columns of any other name come back as they were; an input that has
columns kept_text or lines_gone loses those to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, hide, let, save, show, small

WINDOW, MIN_LINES, LONG_LINE = 1, 2, 160
#: Matches with one source document that are extended together; a source with more is dealt to several groups.
SHARE = 1024
_BLANK = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, long_line: int) -> DataFrame:
    """doc_id, the text's hash and its non-blank lines: two hashes, places in the text and whether they are long."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    trimmed = F.transform(lines, lambda x, i: F.struct(F.trim(x, F.lit(_BLANK)).alias("t"), (i + 1).alias("at")))
    full = F.transform(
        F.filter(trimmed, lambda s: s["t"] != ""),
        lambda s: F.struct(F.xxhash64(s["t"]).alias("h"), F.xxhash64(F.lit("second"), s["t"]).alias("g"), s["at"].alias("at"), (F.length(s["t"]) >= long_line).alias("long")),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit("second"), "text").alias("tg"), full.alias("lines"))
    return rows.select("doc_id", "th", "tg", *[F.col(f"lines.{c}").alias(c) for c in ("h", "g", "at", "long")])


def _fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """(doc, doc_id, th, pos, n, key, other) of the chosen pairs (n = 2) and long lines (n = 1); pos counts non-blank lines from 1."""
    kind = "array<struct<key:bigint,neg:int,n:int,other:bigint>>"
    none = F.array().cast(kind)
    two = lambda c, i: F.xxhash64(F.element_at(c, i), F.element_at(c, i + 1))
    pair = F.when(F.size("h") >= 2, F.transform(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.struct(two("h", i).alias("key"), (-i).alias("neg"), F.lit(2).alias("n"), two("g", i).alias("other")))).otherwise(none)
    rows = docs.withColumn("pairs", pair)
    if window > 1:
        least = F.transform(F.sequence(F.lit(1), F.greatest(F.size("pairs") - window + 1, F.lit(1))), lambda i: F.array_min(F.slice("pairs", i, window)))
        rows = rows.withColumn("pairs", F.when(F.size("pairs") > 0, F.array_distinct(least)).otherwise(none))
    alone = F.filter(
        F.transform("h", lambda x, i: F.when(F.element_at("long", i + 1), F.struct(F.xxhash64(x, F.lit("line")).alias("key"), (-(i + 1)).alias("neg"), F.lit(1).alias("n"), F.element_at("g", i + 1).alias("other")))),
        lambda s: s.isNotNull(),
    )
    rows = rows.select("doc", "doc_id", "th", F.explode(F.concat("pairs", alone)).alias("f"))
    return rows.select("doc", "doc_id", "th", (-F.col("f.neg")).alias("pos"), F.col("f.n").alias("n"), F.col("f.key").alias("key"), F.col("f.other").alias("other"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many lines agree from the beginning of two lists on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def _part(h: str, g: str, begin: Column, n: Column) -> Column:
    """Both hashes of ``n`` lines from ``begin`` on (fewer at the ends of the text)."""
    first = F.greatest(begin, F.lit(1))
    many = F.greatest(n - (first - begin), F.lit(0))
    return F.arrays_zip(F.slice(h, first, many).alias("h"), F.slice(g, first, many).alias("g"))


def repeated_lines(docs: DataFrame, window: int = WINDOW, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, th and tg (the text's hashes) and the places in the text (from 1) of the lines that go."""
    spark = docs.sparkSession
    lines, lines_at = save(_lines(docs.select("doc_id", "text"), long_line).dropDuplicates(["doc_id", "th", "tg"]).withColumn("doc", F.monotonically_increasing_id()))
    prints = _fingerprints(lines.select("doc", "doc_id", "th", "h", "g", "long"), window)
    where = F.struct(F.col("doc_id").isNotNull(), "doc_id", "th", "pos", "doc")
    hub = prints.groupBy("key", "other").agg(F.min(where).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", "other", F.col("hub.doc").alias("src"), F.col("hub.pos").alias("src_pos"))
    hub, hub_at = save(hub)
    met = prints.join(small(hub), ["key", "other"]).filter("doc <> src OR pos <> src_pos").select("doc", "pos", "n", "src", "src_pos")
    # the lines up to the next match on either side, which a match may be extended over
    own = Window.partitionBy("doc", *([F.col("src"), F.col("pos") - F.col("src_pos")] if min_lines > 2 else [])).orderBy("pos", "n")
    met = met.withColumn("low", F.coalesce(F.lag("pos").over(own), F.lit(0))).withColumn("high", F.lead("pos").over(own))
    met, met_at = save(met)
    before, after = F.col("pos") - F.col("low") - 1, F.coalesce(F.col("high"), F.lit(1 << 30)) - F.col("pos") - F.col("n")
    room = met.join(lines.select("doc", "h", "g", F.size("h").alias("size"), "long"), "doc")
    room = room.withColumn("before", F.greatest(before, F.lit(0))).withColumn("after", F.greatest(F.least(after, F.col("size") - F.col("pos") - F.col("n") + 1), F.lit(0)))
    mine = room.select(
        "doc", "pos", "n", "src", "src_pos", "before", "after",
        F.reverse(_part("h", "g", F.col("pos") - F.col("before"), F.col("before"))).alias("back"), _part("h", "g", F.col("pos") + F.col("n"), F.col("after")).alias("ahead"),
    )
    # only matches that may be extended need their source's lines
    short, wide = mine.filter("before = 0 AND after = 0"), mine.filter("before > 0 OR after > 0")
    hot = met.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts")).filter("parts > 1")
    hot, hot_at = save(hot)
    parts = F.coalesce("parts", F.lit(1))
    wide = wide.join(small(hot), "src", "left").withColumn("part", F.pmod(F.xxhash64("doc", "pos"), parts).cast("int")).drop("parts")
    source = lines.select(F.col("doc").alias("src"), F.col("h").alias("src_h"), F.col("g").alias("src_g")).join(small(hot), "src", "left")
    source = source.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    sides = wide.join(source, ["src", "part"])
    shift = (F.col("pos") - F.col("src_pos")).alias("shift")
    src_back = F.reverse(_part("src_h", "src_g", F.col("src_pos") - F.col("before"), F.col("before")))
    src_ahead = _part("src_h", "src_g", F.col("src_pos") + F.col("n"), F.col("after"))
    grown = sides.select("doc", "pos", "n", "src", shift, _agreeing(F.col("back"), src_back).alias("down"), _agreeing(F.col("ahead"), src_ahead).alias("up"))
    runs = short.select("doc", "pos", "n", "src", shift, F.lit(0).alias("down"), F.lit(0).alias("up")).unionByName(grown)
    runs = runs.select("doc", (F.col("pos") - F.col("down")).alias("first"), (F.col("n") + F.col("down") + F.col("up")).alias("many"), (F.col("n") == 1).alias("long"), "src", "shift")
    if min_lines > 2:  # matches of one source that touch are one run
        order = Window.partitionBy("doc", "src", "shift").orderBy("first")
        end = F.max(F.col("first") + F.col("many")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("new", (F.col("first") > F.coalesce(end, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy("doc", "src", "shift", "island").agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("many")) - F.min("first")).alias("many"), F.max("long").alias("long"))
    runs = runs.filter((F.col("many") >= min_lines) | F.col("long"))
    gone = runs.groupBy("doc").agg(F.collect_list(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1)).alias("p"))
    gone = gone.select("doc", F.array_sort(F.array_distinct(F.flatten("p"))).alias("p"))
    out = gone.join(lines.select("doc", "doc_id", "th", "tg", "at"), "doc").select("doc_id", "th", "tg", F.transform("p", lambda i: F.element_at("at", i)).alias("gone"))
    out, _ = save(out)
    drop(spark, lines_at, hub_at, met_at, hot_at)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """``docs`` with the column kept_text (its text without repeated lines) and lines_gone (how many)."""
    docs = docs.drop("kept_text", "lines_gone")
    rows = hide(docs, "doc_id", "text")
    gone = repeated_lines(docs, window, min_lines, long_line).select(F.col("doc_id").alias("octa_id"), F.col("th").alias("octa_th"), F.col("tg").alias("octa_tg"), F.col("gone").alias("octa_gone"))
    same = rows["doc_id"].eqNullSafe(F.col("octa_id")) & (F.xxhash64("text") == F.col("octa_th")) & (F.xxhash64(F.lit("second"), "text") == F.col("octa_tg"))
    rows = rows.join(small(gone, held=F.size("octa_gone")), same, "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("octa_gone"))
    kept = let(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.element_at(lines, i)), "\n"))
    rows = rows.withColumn("kept_text", F.when(F.col("octa_gone").isNull(), F.col("text")).otherwise(kept))
    rows = rows.withColumn("lines_gone", F.coalesce(F.size("octa_gone"), F.lit(0)).cast("long")).drop("octa_id", "octa_th", "octa_tg", "octa_gone")
    return show(rows, docs, "doc_id", "text")


def report(docs: DataFrame) -> DataFrame:
    """Of each document: its lines, how many go, and a digest of what stays."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.greatest(F.col("lines_gone"), F.lit(0)).alias("n_deleted"),
        F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
