"""More registered queries: byte machines, vectors, corpus sources, evaluation and counterfactuals, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytesql as B
from ..functions import features as X
from ..operators import bayes, corpus, engines, evaluate, html, route
from ..sources import manifest, variants
from .catalogue import _DETECT_LABELS, _EVAL, _model, _NB, _T_BIN, HX, LIST, NUMS, ORACLE_SQL, QUERIES, _eval, _nb_sql, query, raws, table

__all__ = ["ORACLE_SQL", "QUERIES"]

#: The Latin-1 view of a list of bytes in SQL.
VIEW = "coalesce(list_aggregate(list_transform({0}, lambda b: chr(b)), 'string_agg', ''), '')"
#: Documents as bytes of Latin-1, other characters as question marks; in SQL that view is a text.
_PLAIN = "regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{FF}]', '?', 'g')"


def _latin(spark, sf_dir, *more: str):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x{00}-\x{FF}]", "?")
    return table(spark, sf_dir, "documents").select("doc_id", *more, F.encode(text, "ISO-8859-1").alias("raw"))


def _machine_sql() -> str:
    parts = []
    for name, (unit, part) in B.MACHINES.items():
        used = "u" if name == "utf-8" else "u + p"
        parts.append(f"""SELECT doc_id, '{name}' AS encoding, CASE WHEN u + p < n THEN 'invalid' WHEN p > 0 THEN 'incomplete' ELSE 'valid' END AS status, CAST({used} AS BIGINT) AS consumed
FROM (SELECT *, length(regexp_extract(substr(v, u + 1), '^(?:{part})')) AS p FROM (SELECT doc_id, v, length(v) AS n, length(regexp_extract(v, '^(?:{unit})*')) AS u FROM w))""")
    cut = LIST.format(f"substr({HX}, 3, 2 * (300 + doc_id % 7))")
    return f"WITH w AS (SELECT doc_id, {VIEW.format(cut)} AS v FROM documents) " + " UNION ALL ".join(parts)


@query(_machine_sql())
def q55_byte_machines(spark, sf_dir):
    rows = raws(spark, sf_dir).select("doc_id", F.substr("raw", F.lit(2), (300 + F.col("doc_id") % 7).cast("int")).alias("raw"))
    every = F.array(*[F.struct(F.lit(e).alias("encoding"), B.machine(F.col("raw"), e).alias("m")) for e in B.MACHINES])
    return rows.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.encoding", "e.m.status", "e.m.consumed")


_U, _P = B.MACHINES["utf-8"]


def _lossy_sql(view: str) -> str:
    """Characters and replacements of a lossy reading of a Latin-1 view as UTF-8."""
    marked = f"SELECT doc_id, {view} AS v, regexp_replace({view}, '{_U}', 'V', 'g') AS m FROM documents"
    return f"SELECT doc_id, length(v) AS n, len(regexp_extract_all(m, '{_P}|[\\x{{80}}-\\x{{FF}}]')) AS wrong, len(regexp_extract_all(m, 'V')) AS fine, len(regexp_extract_all(v, 'ï¿½')) AS given FROM ({marked})"


@query(f"SELECT doc_id, CAST(wrong + given AS BIGINT) AS replaced, CAST(wrong + fine AS BIGINT) AS chars FROM ({_lossy_sql(_PLAIN)})")
def q56_replacement_rate(spark, sf_dir):
    return _latin(spark, sf_dir).select("doc_id", B.lossy_utf8(F.col("raw")).alias("r")).select("doc_id", "r.replaced", "r.chars")


_HEAD = f"substr({_PLAIN}, 1, 4096)"


@query(f"""SELECT doc_id, 'utf-8' AS codec, CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END AS valid, CASE WHEN wrong = 0 THEN 0 ELSE round((wrong + given) / greatest(wrong + fine, 1), 6) END AS replaced FROM ({_lossy_sql(_HEAD)})
UNION ALL SELECT doc_id, 'ascii', CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END, round(h / greatest(n, 1), 6) FROM (SELECT doc_id, length({_HEAD}) AS n, len(regexp_extract_all({_HEAD}, '[\\x{{80}}-\\x{{FF}}]')) AS h FROM documents)""")
def q57_decode_metrics(spark, sf_dir):
    return route.metrics(_latin(spark, sf_dir), "doc_id", ["utf-8", "ascii"]).select("doc_id", "codec", "valid", F.round("replaced", 6).alias("replaced"))


@query()
def q58_script_evidence(spark, sf_dir):
    rows = variants.codec_variants(table(spark, sf_dir, "documents"), ("utf-8", "cp1252")).withColumn("key", F.concat_ws("/", "doc_id", "label"))
    return route.vectors(rows, "key", "evidence").select("key", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


#: The sample of 768 bytes as a list of numbers.
_SAMPLE = LIST.format(f"(CASE WHEN length({HX}) <= 1536 THEN {HX} ELSE substr({HX}, 1, 512) || substr({HX}, 2 * (length({HX}) // 4 - 128) + 1, 512) || substr({HX}, length({HX}) - 511, 512) END)")


@query(f"""WITH d AS (SELECT doc_id, {_SAMPLE} AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS x FROM d),
p AS (SELECT doc_id, unnest(list_zip(l[:-2], l[2:])) AS p FROM d WHERE len(l) > 1)
SELECT doc_id, CAST(x AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL UNION ALL SELECT doc_id, CAST(256 + (p[1] + p[2]) % 256 AS INTEGER), count(*) FROM p GROUP BY ALL
UNION ALL SELECT * FROM (SELECT doc_id, unnest([513, 514, 515, 516, 517]) AS k, unnest([len(list_filter(l, lambda x: x > 127)), len(list_filter(l, lambda x: x = 0)), len(list_filter(l, lambda x: x BETWEEN 32 AND 126)), len(list_filter(l, lambda x: x = 10)), len(list_filter(l, lambda x: x = 13))]) AS n FROM d) WHERE n > 0""")
def q59_base_vector(spark, sf_dir):
    """The 518 features as counts: shares times what they are shares of."""
    rows = raws(spark, sf_dir)
    v = route.vectors(rows, "doc_id", "base").join(rows.select("doc_id", F.least(F.length("raw"), F.lit(768)).alias("size")), "doc_id")
    v = v.select("doc_id", "size", F.posexplode("vector").alias("k", "v")).filter("k <> 512")
    n = F.round(F.col("v") * F.when(F.col("k").between(256, 511), F.col("size") - 1).otherwise(F.col("size"))).cast("long")
    return v.select("doc_id", "k", n.alias("n")).filter("n > 0")


@query(f"""WITH d AS (SELECT doc_id, {_SAMPLE} AS l, CASE WHEN try(decode(unhex(substr({HX}, 1, 8192)))) IS NOT NULL THEN 'U' ELSE 'X' END AS route FROM documents),
p AS (SELECT doc_id, unnest(list_zip(l[:-2], l[2:])) AS p FROM d WHERE len(l) > 1 AND route = 'U')
SELECT doc_id, CAST((p[2] - p[1] + 256) % 256 AS INTEGER) AS k, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT doc_id, CAST(256 + (xor(p[1], p[2]) >> 2) AS INTEGER), count(*) FROM p GROUP BY ALL""")
def q60_extra_vector(spark, sf_dir):
    """Differences and exclusive ors of the 368 features, as counts, where the route is U."""
    rows = raws(spark, sf_dir).withColumn("route", B.signals(F.col("raw"))["route"]).filter("route = 'U'")
    v = route.vectors(rows, "doc_id", "extra").join(rows.select("doc_id", (F.least(F.length("raw"), F.lit(768)) - 1).alias("size")), "doc_id")
    v = v.select("doc_id", "size", F.posexplode("vector").alias("k", "v")).filter("k < 320")
    return v.select("doc_id", "k", F.round(F.col("v") * F.col("size")).cast("long").alias("n")).filter("n > 0")


@query()
def q61_feature_variants(spark, sf_dir):
    v = route.variant_vectors(raws(spark, sf_dir), "doc_id")
    total = lambda k: F.round(F.aggregate(k, F.lit(0.0), lambda a, x: a + x), 6)
    each = [F.struct(F.lit(k).alias("variant"), F.size(k).alias("width"), total(k).alias("total")) for k in route.VARIANTS]
    return v.select("doc_id", F.explode(F.array(*each)).alias("v")).select("doc_id", "v.*")


@query(_nb_sql(_T_BIN, 2048) + ", e AS (SELECT doc_id, lang, exp(50 * (score - max(score) OVER (PARTITION BY doc_id))) AS e FROM s) SELECT doc_id, lang, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM e")
def q62_softmax(spark, sf_dir):
    rows = raws(spark, sf_dir, "lang")
    s = bayes.score_objects(rows, bayes.fit(rows, "lang"), "doc_id", "lang").withColumn("score", 50 * F.col("score"))
    return evaluate.softmax(s, "doc_id", "score").select("doc_id", "lang", F.round("p", 6).alias("p"))


@query(_nb_sql(_T_BIN, 2048) + ", r AS (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM s) SELECT a.doc_id, round(a.score - b.score, 6) AS margin FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2")
def q63_margin(spark, sf_dir):
    rows = raws(spark, sf_dir, "lang")
    s = bayes.rank(bayes.score_objects(rows, bayes.fit(rows, "lang"), "doc_id", "lang"), "doc_id", "lang", 2)
    return s.filter("rank = 1").select("doc_id", F.round("margin", 6).alias("margin"))


_DIRS = ("utf-8-german", "cp1252-de", "utf-16-be", "utf-16be-ru", "None-None", "ascii", "latin1", "klingon-xx", "koi8-r-russian", "iso8859-1-fr", "None", "big5-chinese", "shift_jis-ja")
_KNOWN = corpus.aliases([*_DIRS, *(d.rpartition("-")[0] for d in _DIRS)])


@query(f"""WITH d AS (SELECT dir, regexp_extract(dir, '^(.*)-', 1) AS base, regexp_extract(dir, '-([^-]*)$', 1) AS ending FROM (VALUES {", ".join(f"('{d}')" for d in _DIRS)}) t(dir)),
k AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _KNOWN.items())}) t(name, label)),
n AS (SELECT dir, CASE WHEN dir NOT IN ('None', 'None-None', 'ascii') AND contains(dir, '-') AND (ending IN ({", ".join(f"'{x}'" for x in corpus.LANGUAGES)}) OR (ending IN ({", ".join(f"'{x}'" for x in corpus.ISO_CODES)}) AND base IN (SELECT name FROM k))) THEN base ELSE dir END AS name FROM d)
SELECT dir, label FROM n JOIN k USING (name)""")
def q64_label_from_directory(spark, sf_dir):
    return corpus.directory_labels(spark.createDataFrame([(d,) for d in _DIRS], "dir string"))


@query("""SELECT doc_id, replace(replace(lower(CASE doc_id % 3 WHEN 0 THEN 'CulturaX_mC4_' WHEN 1 THEN 'culturax_OSCAR-2301_' ELSE 'Other_' END || source), 'culturax_mc4_', 'culturax_'), 'culturax_oscar-2301_', 'culturax_') AS "group" FROM documents""")
def q65_source_group(spark, sf_dir):
    front = F.when(F.col("doc_id") % 3 == 0, "CulturaX_mC4_").when(F.col("doc_id") % 3 == 1, "culturax_OSCAR-2301_").otherwise("Other_")
    return table(spark, sf_dir, "documents").select("doc_id", B.source_group(F.concat(front, "source")).alias("group"))


@query(f"""WITH p AS (SELECT doc_id, size, {HX} AS hx, CASE size WHEN 0 THEN {HX} ELSE substr({HX}, 1, 2 * size) END AS p FROM documents, (VALUES (256), (4096), (0)) t(size)),
c AS (SELECT doc_id, size, list_filter([p, substr(p, 1, length(p) - 2), substr(p, 1, length(p) - 4), substr(p, 1, length(p) - 6)], lambda x: try(decode(unhex(x))) IS NOT NULL)[1] AS p FROM p),
s AS (SELECT doc_id, size, sha256(unhex(p)) AS sha256, length(p) // 2 AS n FROM c WHERE length(p) >= 64)
SELECT doc_id, size, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id, size) AS r FROM s) WHERE r = 1""")
def q66_length_windows(spark, sf_dir):
    return corpus.length_windows(raws(spark, sf_dir), "raw").select("doc_id", "size", "sha256")


@query("""WITH c AS (SELECT doc_id, lang, k, substr(t, 1024 * k + 1, 1024) AS chunk FROM (SELECT doc_id, lang, coalesce(text, '') AS t, unnest(generate_series(0, greatest(length(coalesce(text, '')) + 1023, 1024) // 1024 - 1)) AS k FROM documents)),
a AS (SELECT * FROM c WHERE length(chunk) >= 128 AND length(regexp_replace(chunk, '[\\x00-\\x7F]', '', 'g')) >= 5 AND regexp_full_match(chunk, '[\\x{00}-\\x{FF}]*'))
SELECT lang, doc_id, CAST(k AS INTEGER) AS k, md5(chunk) AS chunk_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) AS r FROM a) WHERE r <= 8""")
def q67_synthetic_chunks(spark, sf_dir):
    rows = corpus.chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), "text")
    rows = rows.filter(F.col("chunk").rlike(r"^[\x{00}-\x{FF}]*$")).select("lang", "doc_id", "k", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))
    return corpus.balanced_sample(rows, "lang", F.struct("doc_id", "k")).drop("rank")


@query("SELECT lang, count(*) AS pairs, count(*) FILTER (regexp_full_match(coalesce(text, ''), '[\\x{00}-\\x{FF}]*')) AS same FROM documents GROUP BY lang")
def q68_paired_reference(spark, sf_dir):
    """Legacy files and their UTF-8 twins, joined by stem: do both read as the same text?"""
    legacy = _latin(spark, sf_dir, "lang").select(F.concat(F.lit("t"), "doc_id").alias("stem"), "lang", F.decode("raw", "ISO-8859-1").alias("read"))
    twin = raws(spark, sf_dir).select(F.concat(F.lit("t"), "doc_id").alias("stem"), F.col("raw").cast("string").alias("text"))
    return legacy.join(twin, "stem").groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("read") == F.col("text")).alias("same"))


_TEMPLATES = ("Grüße aus {}", "café {} noir", "{} señor", "naïve {} façade")


@query(f"""SELECT t AS template, r AS repeats, b AS control, p AS place, md5(CASE p WHEN 0 THEN chr(b) || s WHEN 1 THEN substr(s, 1, length(s) // 2) || chr(b) || substr(s, length(s) // 2 + 1) ELSE s || chr(b) END) AS text_md5
FROM (SELECT t, r, b, p, repeat([{", ".join(f"'{x}'" for x in _TEMPLATES)}][t + 1], r) AS s FROM range(4) a(t), (VALUES (1), (4), (16)) c(r), (SELECT CAST(range AS INTEGER) FROM range(128, 139)) d(b), range(3) e(p))""")
def q69_adversarial_controls(spark, sf_dir):
    """Texts with a control character at the front, in the middle and at the end: templates x repeats x controls x places."""
    rows = spark.range(4).select(F.col("id").alias("template")).crossJoin(spark.createDataFrame([(1,), (4,), (16,)], "repeats int")).crossJoin(spark.range(128, 139).select(F.col("id").alias("control"))).crossJoin(spark.range(3).select(F.col("id").alias("place")))
    s = F.repeat(F.get(F.array(*[F.lit(x) for x in _TEMPLATES]), F.col("template").cast("int")), F.col("repeats"))
    control = F.decode(F.unhex(F.hex("control")), "ISO-8859-1")
    half = F.floor(F.length(s) / 2).cast("int")
    text = F.when(F.col("place") == 0, F.concat(control, s)).when(F.col("place") == 1, F.concat(F.substr(s, F.lit(1), half), control, F.substr(s, half + 1, F.length(s)))).otherwise(F.concat(s, control))
    return rows.select("template", "repeats", "control", "place", F.md5(text.cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, base64(unhex(substr({HX}, 1, 512))) AS b64, true AS same FROM documents")
def q70_base64(spark, sf_dir):
    rows = raws(spark, sf_dir).select("doc_id", F.substr("raw", F.lit(1), F.lit(256)).alias("raw"))
    b64 = F.regexp_replace(F.base64("raw"), r"\s", "")
    return rows.select("doc_id", b64.alias("b64"), (F.unbase64(b64) == F.col("raw")).alias("same"))


@query("""WITH a AS (SELECT doc_id, lang, n_chars, n_chars / 7.0::DOUBLE AS score FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, n_chars, n_chars / 7.0::DOUBLE + CASE WHEN doc_id % 7 = 0 THEN 0.001 ELSE 1e-13 END AS score FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, unnest(CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN ['*'] ELSE list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN abs(a.score - b.score) > 1e-9 THEN 'score' END], lambda x: x IS NOT NULL) END) AS field FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def q71_golden_verify(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    score = F.col("n_chars") / F.lit(7.0)
    gold = docs.filter(i % 11 != 0).select("doc_id", "lang", "n_chars", score.alias("score"))
    new = docs.filter(i % 13 != 0).select("doc_id", F.when(i % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "n_chars", (score + F.when(i % 7 == 0, 0.001).otherwise(1e-13)).alias("score"))
    return evaluate.changed(gold, new, "doc_id")


@query(f"""WITH p AS (SELECT doc_id, lang, substr({HX}, 1, 131072) AS p FROM documents),
c AS (SELECT doc_id, lang, list_filter([p, substr(p, 1, length(p) - 2), substr(p, 1, length(p) - 4), substr(p, 1, length(p) - 6)], lambda x: try(decode(unhex(x))) IS NOT NULL)[1] AS p FROM p),
s AS (SELECT doc_id, lang, sha256(unhex(p)) AS sha256 FROM c WHERE length(p) BETWEEN 48 AND 2097152), f AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS r FROM s)
SELECT lang, doc_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('20261015:' || doc_id)) AS k FROM f WHERE r = 1) WHERE k <= 8""")
def q72_balanced_directory(spark, sf_dir):
    """The first 64 KiB cut to whole characters, admitted by size, once each, eight of a label by hash."""
    part = B.trimmed(F.substr("raw", F.lit(1), F.lit(65536)))
    rows = raws(spark, sf_dir, "lang").withColumn("raw", part).filter(F.length("raw").between(24, 1 << 20)).select("doc_id", "lang", F.sha2("raw", 256).alias("sha256"))
    rows = corpus.first_seen(rows, ["sha256"], ["doc_id"])
    key = F.sha2(F.concat(F.lit("20261015:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return corpus.balanced_sample(rows, "lang", key).select("lang", "doc_id", "sha256")


@query("""WITH t AS (SELECT * FROM (VALUES ('src0', 'utf-8'), ('src1', 'cp1252'), ('src2', 'utf-8'), ('gone', 'big5')) t(source, label)), l AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT coalesce(t.source, l.source) AS source, label, coalesce(n, 0) AS n, CASE WHEN t.source IS NULL THEN 'unlisted' WHEN l.source IS NULL THEN 'missing' ELSE 'listed' END AS state FROM t FULL OUTER JOIN l ON t.source = l.source""")
def q73_fixture_labels(spark, sf_dir):
    """A fixed table of labels against what a listing holds: both differences show."""
    fixed = spark.createDataFrame([("src0", "utf-8"), ("src1", "cp1252"), ("src2", "utf-8"), ("gone", "big5")], "source string, label string")
    listed = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("label").isNull(), "unlisted").when(F.col("n").isNull(), "missing").otherwise("listed")
    return fixed.join(listed, "source", "full_outer").select("source", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), state.alias("state"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM d WHERE n <= 256),
l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, greatest(1, count(*) OVER () // 220) AS step FROM d WHERE n > 256), k AS (SELECT doc_id, row_number() OVER (ORDER BY r) AS q FROM l WHERE r % step = 0)
SELECT 'short' AS part, doc_id FROM s WHERE r <= 80 UNION ALL SELECT 'long', doc_id FROM k WHERE q <= 220 UNION ALL SELECT 'edge', -e FROM range(1, 5) t(e)""")
def q74_resource_fixture(spark, sf_dir):
    """Short objects first, long ones by stride, and edge rows; positions come from a two-level numbering."""
    rows = raws(spark, sf_dir).select("doc_id", F.length("raw").alias("n"))
    short, long = (corpus.numbered(rows.filter(c), "doc_id") for c in ("n <= 256", "n > 256"))
    step = long.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 220)).alias("step"))
    some = long.crossJoin(F.broadcast(step)).filter("place % step = 0 AND place < 220 * step")  # step is one row
    edge = spark.range(1, 5).select(F.lit("edge").alias("part"), (-F.col("id")).alias("doc_id"))
    return short.filter("place < 80").select(F.lit("short").alias("part"), "doc_id").union(some.select(F.lit("long").alias("part"), "doc_id")).union(edge)


_META = f"""lower(regexp_extract({VIEW.format(LIST.format("substr(hex(encode(coalesce(html, ''))), 1, 2048)"))}, '(?i)<meta\\b[^>]{{0,256}}?charset\\s*=\\s*["'']?\\s*([A-Za-z0-9_.:-]+)', 1))"""
_SNIFF = "lower(regexp_extract(coalesce(html, ''), '(?i)charset\\s*=\\s*[\"'']?([A-Za-z0-9_.:-]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, {_META} AS a, {_SNIFF} AS b, md5(coalesce(html, '')) AS text_md5, CAST(position('charset' IN coalesce(html, '')) AS INTEGER) AS place, CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<meta')) AS INTEGER) AS metas FROM pages)
SELECT page_id, a <> b AS disagree, text_md5, place, metas FROM (SELECT *, row_number() OVER (PARTITION BY a <> b, a ORDER BY page_id) AS r FROM p) WHERE a <> b OR r <= 12""")
def q75_arbitration_subset(spark, sf_dir):
    """All pages on which two sniffers disagree, and twelve controls of each label on which they agree."""
    h = F.coalesce("html", F.lit(""))
    rows = table(spark, sf_dir, "pages").select(
        "page_id", B.meta_charset(h.cast("binary")).alias("a"), F.lower(F.regexp_extract(h, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)).alias("b"),
        F.md5(h.cast("binary")).alias("text_md5"), F.instr(h, F.lit("charset")).alias("place"), F.regexp_count(h, F.lit("(?i)<meta")).alias("metas"),
    )
    own = ["page_id", "disagree", "text_md5", "place", "metas"]
    rows = rows.withColumn("disagree", F.col("a") != F.col("b"))
    return rows.filter("disagree").select(own).unionByName(corpus.balanced_sample(rows.filter("NOT disagree"), "a", F.col("page_id"), 12).select(own))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT page_id, h, regexp_extract_all(h, '(?i)charset\\s*=\\s*["'']?[A-Za-z0-9_.:-]+') AS w, regexp_extract_all(h, '(?i)charset\\s*=\\s*["'']?([A-Za-z0-9_.:-]+)', 1) AS t FROM p)
SELECT page_id, CAST(length(h) AS BIGINT) AS n, CAST(list_sum(list_transform(t, lambda x: length(x))) AS BIGINT) AS masked FROM m WHERE len(w) > 0""")
def q76_mask_all_charsets(spark, sf_dir):
    h = F.coalesce("html", F.lit(""))
    masked = B.mask_charset(h)
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.length(masked).cast("long").alias("n"), (marks(masked) - marks(h)).cast("long").alias("masked"))
    return rows.filter("masked > 0")


@query(f"""WITH d AS (SELECT doc_id, label, {_PLAIN} AS t FROM documents, (VALUES ('latin1'), ('UTF-8'), (' us-ascii '), ('x-unknown')) v(label))
SELECT doc_id, label, CASE label WHEN 'UTF-8' THEN 'utf-8' WHEN 'x-unknown' THEN NULL ELSE 'windows-1252' END AS encoding,
CASE label WHEN 'UTF-8' THEN length(regexp_replace(t, '{_U}', '', 'g')) = 0 WHEN 'x-unknown' THEN false ELSE NOT regexp_matches(t, '[\\x{{81}}\\x{{8D}}\\x{{8F}}\\x{{90}}\\x{{9D}}]') END AS valid FROM d""")
def q77_whatwg_decode(spark, sf_dir):
    labels = F.explode(F.array(*[F.lit(x) for x in ("latin1", "UTF-8", " us-ascii ", "x-unknown")])).alias("label")
    return html.decode_whatwg(_latin(spark, sf_dir).select("doc_id", labels, "raw")).select("doc_id", "label", "encoding", "valid")


@query("SELECT doc_id, CAST(doc_id % 12 AS BIGINT) AS han, doc_id % 12 >= 2 AS some, doc_id % 12 >= 10 AS many FROM documents")
def q78_han_evidence(spark, sf_dir):
    n = B.han_count(F.concat(F.repeat(F.lit("漢"), (F.col("doc_id") % 12).cast("int")), F.coalesce("text", F.lit("")))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("han"), (n >= 2).alias("some"), (n >= 10).alias("many"))


_C1 = f"len(list_filter({NUMS}, lambda x: x BETWEEN 128 AND 159)) > 0"
_OWN_C1 = "regexp_matches(coalesce(text, ''), '[\\x{80}-\\x{9F}]')"


@query(f"""SELECT doc_id, warned, CASE WHEN warned THEN 'utf-8' ELSE 'iso8859-1' END AS reranked, CASE WHEN warned THEN NULL ELSE 'iso8859-1' END AS abstained FROM (SELECT doc_id, {_C1} AND NOT {_OWN_C1} AS warned FROM documents)""")
def q79_c1_rerank(spark, sf_dir):
    """Bytes of UTF-8 read as Latin-1: the first other candidate without C1 controls, or no answer, instead."""
    found = _candidates(spark, sf_dir)
    warned = F.exists(F.slice("c", 1, 1), lambda x: x["c1"]) & F.exists(F.slice("c", 2, 9), lambda x: ~x["c1"])
    plain = F.filter("c", lambda x: ~x["c1"])
    first = F.col("c")[0]["label"]
    return found.select("doc_id", warned.alias("warned"), F.when(warned, F.get(plain, 0)["label"]).otherwise(first).alias("reranked"), F.when(~warned, first).alias("abstained"))


def _candidates(spark, sf_dir):
    """doc_id, text and c, the readings of its bytes under iso8859-1 and utf-8: label, text, c1."""
    raw = F.col("raw")
    one = F.struct(F.lit("iso8859-1").alias("label"), B.latin1(raw).alias("text"), (B.c1_count(B.latin1(raw)) > 0).alias("c1"))
    two = F.struct(F.lit("utf-8").alias("label"), raw.cast("string").alias("text"), (B.c1_count(raw.cast("string")) > 0).alias("c1"))
    return raws(spark, sf_dir).select("doc_id", raw.cast("string").alias("text"), F.array(one, two).alias("c"))


@query("SELECT doc_id, coalesce(text, '') = '' OR regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*') AS first, true AS any_candidate FROM documents")
def q80_recoverability(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    same = lambda x: x["text"] == F.col("text")
    return found.select("doc_id", F.exists(F.slice("c", 1, 1), same).alias("first"), F.exists("c", same).alias("any_candidate"))


_TAG = "<[A-Za-z/!?][^<>]*>"
_GUESS_SQL = "CASE WHEN regexp_full_match({0}, '[\\t\\n\\r -~]+') THEN 'ascii' WHEN length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) >= 3 THEN 'utf-8' ELSE 'unsure' END"


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT page_id, h, regexp_replace(h, '{_TAG}', ' ', 'g') AS t, len(regexp_extract_all(h, '{_TAG}')) AS tags FROM p),
g AS (SELECT {_GUESS_SQL.format("h")} AS whole, {_GUESS_SQL.format("t")} AS masked FROM m WHERE tags >= 3 AND octet_length(encode(t)) > 64)
SELECT whole, masked, count(*) AS n FROM g GROUP BY ALL""")
def q81_masked_redetection(spark, sf_dir):
    """What a rule says of pages with and without their tags."""
    rows = table(spark, sf_dir, "pages").select(F.coalesce("html", F.lit("")).alias("h")).withColumn("m", html.mask_tags(F.col("h")))
    rows = rows.filter((F.col("m.tags") >= 3) & (F.length(F.col("m.masked").cast("binary")) > 64))
    guess = lambda c: F.when(c.rlike(r"^[\t\n\r -~]+\z"), "ascii").when(F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) >= 3, "utf-8").otherwise("unsure")
    return rows.groupBy(guess(F.col("h")).alias("whole"), guess(F.col("m.masked")).alias("masked")).agg(F.count(F.lit(1)).alias("n"))


_WEB = ", ".join(f"('{a}', '{b}')" for a, b in html.WEB.items())


@query(f"""WITH w AS (SELECT * FROM (VALUES {_WEB}) t(label, name)), p AS (SELECT page_id % 4 AS grp, {_META} AS a, {_SNIFF} AS b, CASE WHEN page_id % 5 = 0 THEN 'latin1' ELSE 'utf8' END AS browser FROM pages)
SELECT grp, count(*) AS n, count(*) FILTER (x.name = z.name) AS agrees_meta, count(*) FILTER (y.name = z.name) AS agrees_sniff FROM p LEFT JOIN w x ON x.label = a LEFT JOIN w y ON y.label = b LEFT JOIN w z ON z.label = browser GROUP BY grp""")
def q82_browser_arbitration(spark, sf_dir):
    """How often a supplied browser label agrees with each sniffer, after label names are resolved."""
    h = F.coalesce("html", F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in html.WEB.items() for x in kv])
    name = lambda c: F.element_at(names, c)
    rows = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 4).alias("grp"), name(B.meta_charset(h.cast("binary"))).alias("a"), name(F.lower(F.regexp_extract(h, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1))).alias("b"),
        name(F.when(F.col("page_id") % 5 == 0, "latin1").otherwise("utf8")).alias("z"),
    )
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("z")).alias("agrees_meta"), F.count_if(F.col("b") == F.col("z")).alias("agrees_sniff"))


_ROWS = f"SELECT doc_id, lang AS encoding, source AS \"group\", CASE WHEN doc_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split, sha256(encode(coalesce(text, ''))) AS sha256, sha256(unhex(substr({HX}, 1, 8192))) AS prefix_sha256 FROM documents"


@query(f"""SELECT 'historical' AS kind, sha256(string_agg(prefix_sha256 || chr(0) || encoding || chr(0) || "group" || chr(0), '' ORDER BY doc_id)) AS fingerprint FROM ({_ROWS})
UNION ALL SELECT 'canonical', sha256('[' || string_agg('{{"encoding":"' || encoding || '","group":"' || "group" || '","sha256":"' || sha256 || '","split":"' || split || '"}}', ',' ORDER BY doc_id) || ']') FROM ({_ROWS})""")
def q83_fingerprints(spark, sf_dir):
    d = corpus.digests(F.col("raw"))
    rows = raws(spark, sf_dir, "lang", "source").select("doc_id", F.col("lang").alias("encoding"), F.col("source").alias("group"), F.when(F.col("doc_id") % 4 == 0, "validation").otherwise("train").alias("split"), d["sha256"].alias("sha256"), d["prefix_sha256"].alias("prefix_sha256"))
    one, two = corpus.historical_fingerprint(rows, "doc_id"), corpus.canonical_fingerprint(rows, "doc_id").drop("n")
    return one.select(F.lit("historical").alias("kind"), "fingerprint").union(two.select(F.lit("canonical").alias("kind"), "fingerprint"))


_LOGP = f"WITH {_NB.format(bin=_T_BIN)}, p AS (SELECT lang, ln((n + 0.5) / (total + 0.5 * 2048)) AS x FROM m JOIN tot USING (lang)), q AS (SELECT lang, x, CAST(CAST(x AS FLOAT) AS DOUBLE) AS y, round(x, 1) AS z FROM p)"


@query(f"{_LOGP} SELECT lang, count(*) AS n, count(*) FILTER (abs(x - z) > 1e-6) AS above_1e6, count(*) FILTER (abs(x - z) > 1e-2) AS above_1e2, count(*) FILTER (sign(x) <> sign(z)) AS flips, round(max(abs(x - z)), 6) AS largest, round(avg(abs(x - z)), 6) AS mean, round(sqrt(avg((x - z) * (x - z))), 6) AS rms FROM q GROUP BY lang")
def q84_tensor_differences(spark, sf_dir):
    """A model's log probabilities against the same ones rounded to a decimal."""
    rows = bayes.fit(raws(spark, sf_dir, "lang"), "lang").select("lang", F.col("logp").alias("x"), F.round("logp", 1).alias("z"))
    out = evaluate.tensor_differences(rows, "x", "z", ["lang"])
    return out.select("lang", "n", "above_1e6", "above_1e2", "flips", *[F.round(c, 6).alias(c) for c in ("largest", "mean", "rms")])


@query(f"{_LOGP} SELECT lang, count(*) AS n, count(*) FILTER (abs(x - y) > 1e-6) AS above_1e6, max(abs(x - y)) < 1e-5 AS close FROM q GROUP BY lang")
def q85_precision(spark, sf_dir):
    """The same in single precision: how many differ by more than a millionth."""
    rows = bayes.fit(raws(spark, sf_dir, "lang"), "lang").select("lang", F.col("logp").alias("x"), F.col("logp").cast("float").cast("double").alias("y"))
    out = evaluate.tensor_differences(rows, "x", "y", ["lang"])
    return out.select("lang", "n", "above_1e6", (F.col("largest") < 1e-5).alias("close"))


@query("""WITH e AS (SELECT * FROM (VALUES ('documents', '200'), ('languages', '4'), ('sources', '99'), ('only_expected', 'x')) t(fact, value)),
a AS (SELECT 'documents' AS fact, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT 'languages', CAST(count(DISTINCT lang) AS VARCHAR) FROM documents UNION ALL SELECT 'sources', CAST(count(DISTINCT source) AS VARCHAR) FROM documents UNION ALL SELECT 'only_actual', CAST(min(doc_id) AS VARCHAR) FROM documents)
SELECT coalesce(e.fact, a.fact) AS fact, e.value AS expected, a.value AS actual FROM e FULL OUTER JOIN a ON e.fact = a.fact WHERE e.value IS DISTINCT FROM a.value""")
def q86_replay_gate(spark, sf_dir):
    facts = {"documents": F.count(F.lit(1)), "languages": F.count_distinct("lang"), "sources": F.count_distinct("source"), "only_actual": F.min("doc_id")}
    one = table(spark, sf_dir, "documents").agg(*[v.cast("string").alias(k) for k, v in facts.items()])
    actual = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("value")) for k in facts])).alias("f")).select("f.*")
    expected = spark.createDataFrame([("documents", "200"), ("languages", "4"), ("sources", "99"), ("only_expected", "x")], "fact string, value string")
    return evaluate.replay(expected, actual)


@query(f"""WITH e AS ({_EVAL}), j AS (SELECT a.old_ok, b.new_ok FROM e a JOIN e b ON a.doc_id = b.doc_id)
SELECT count(*) AS pairs, count(*) FILTER (new_ok AND NOT old_ok) AS helped, count(*) FILTER (old_ok AND NOT new_ok) AS harmed, count(*) = (SELECT count(*) FROM e) AS complete FROM j""")
def q87_paired_results(spark, sf_dir):
    """Two runs' results joined by key; the join must lose and double nothing."""
    rows = _eval(spark, sf_dir)
    old, new = rows.select("doc_id", "old_ok"), rows.select("doc_id", "new_ok")
    size = old.agg(F.count(F.lit(1)).alias("size"))
    out = old.join(new, "doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("new_ok") & ~F.col("old_ok")).alias("helped"), F.count_if(F.col("old_ok") & ~F.col("new_ok")).alias("harmed"))
    return out.crossJoin(size).select("pairs", "helped", "harmed", (F.col("pairs") == F.col("size")).alias("complete"))  # one row each


@query("""SELECT source, mode, n FROM (SELECT source, lang AS mode, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def q88_mode(spark, sf_dir):
    return evaluate.mode(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query(f"SELECT lang, CASE WHEN NOT old_ok AND NOT new_ok THEN 'abstained' WHEN old_ok THEN 'correct' ELSE 'silent_wrong' END AS outcome, count(*) AS n FROM ({_EVAL}) GROUP BY ALL")
def q89_outcomes(spark, sf_dir):
    rows = _eval(spark, sf_dir)
    return rows.groupBy("lang", evaluate.outcome(F.col("old_ok") | F.col("new_ok"), F.col("old_ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS place FROM (SELECT doc_id, [doc_id % 7, doc_id % 5, (doc_id * 3) % 7, 4] AS v FROM documents)")
def q90_argmax(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.argmax(F.array(i % 7, i % 5, (i * 3) % 7, F.lit(4).cast("long"))).alias("place"))


@query("SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM (SELECT DISTINCT lang || '/' || source || '/' || doc_id AS path FROM documents)")
def q91_total_order(spark, sf_dir):
    """Paths in total order with their places: ranges are sorted apart and numbered by their sizes."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path")).distinct()
    return corpus.numbered(rows, "path").select("path", "place")


@query(f"""WITH d AS (SELECT doc_id, source, sha256(encode(coalesce(text, ''))) AS s, sha256(unhex(substr({HX}, 1, 512))) AS p FROM documents), h AS (SELECT * FROM d WHERE source = 'src0'), t AS (SELECT * FROM d WHERE source <> 'src0')
SELECT doc_id FROM t WHERE s IN (SELECT s FROM h) UNION SELECT doc_id FROM t WHERE p IN (SELECT p FROM h)""")
def q92_evidence_union(spark, sf_dir):
    """Training documents that any kind of evidence flags, once each."""
    rows = raws(spark, sf_dir, "source").select("doc_id", "source", F.sha2("raw", 256).alias("s"), F.sha2(F.substr("raw", F.lit(1), F.lit(256)), 256).alias("p"))
    held, rest = rows.filter("source = 'src0'"), rows.filter("source <> 'src0'")
    flags = [rest.join(held.select(k).distinct(), k, "left_semi").select("doc_id") for k in ("s", "p")]
    return flags[0].union(flags[1]).distinct()


def _manifest_sql(kind: str) -> str:
    own = manifest.KINDS[kind]
    splits = ", ".join(f"'{x}'" for x in own["splits"])
    rules = f"WHEN \"group\" = '' THEN 'missing group' WHEN split NOT IN ({splits}) THEN 'unsupported split' WHEN starts_with(path, '../') THEN 'path escapes manifest directory' WHEN n = 0 THEN 'empty input'"
    rules += " WHEN NOT ok THEN 'label does not decode bytes' WHEN g <> split THEN 'source-group leakage'"
    if own["duplicates"] == "drop":
        rules += " WHEN e <> encoding OR s <> split THEN 'duplicate bytes cross labels/splits'"
    if own["duplicates"] == "error":
        rules += " WHEN s <> split THEN 'duplicated bytes across splits' WHEN e <> encoding THEN 'conflicting labels for identical bytes' WHEN l IS NOT NULL THEN 'duplicated evaluation content'"
    over = "OVER (PARTITION BY {0} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT '{kind}' AS kind, line_no, CASE {rules} END AS rule FROM (SELECT *, first_value(split) {over.format('"group"')} AS g, first_value(split) {over.format("sha")} AS s, first_value(encoding) {over.format("sha")} AS e, first_value(line_no) {over.format("sha")} AS l FROM m)"""


_LINES = f"""WITH m AS (SELECT CAST(doc_id AS BIGINT) AS line_no, CASE WHEN doc_id % 97 = 0 THEN '../' ELSE 'c/' END || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'ascii' ELSE 'utf-8' END AS encoding, CASE WHEN doc_id % 103 = 0 THEN '' ELSE 'g' || (doc_id // 3) END AS "group",
CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id // 3 % 4 = 0 THEN 'validation' ELSE 'train' END AS split, sha256(encode(coalesce(text, ''))) AS sha, octet_length(encode(coalesce(text, ''))) AS n, doc_id % 9 <> 0 OR regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*') AS ok FROM documents)"""


@query(f"{_LINES} SELECT kind, rule, count(*) AS n, min(line_no) AS first FROM ({' UNION ALL '.join(_manifest_sql(k) for k in manifest.KINDS)}) GROUP BY ALL")
def q93_manifest_rules(spark, sf_dir):
    """The first rule that each line breaks, for each kind of manifest."""
    i = F.col("doc_id")
    third = F.floor(i / 3)
    rows = raws(spark, sf_dir).select(
        i.cast("long").alias("line_no"), F.lit(True).alias("json"), F.concat(F.when(i % 97 == 0, "../").otherwise("c/"), i.cast("string")).alias("path"), F.when(i % 9 == 0, "ascii").otherwise("utf-8").alias("encoding"),
        F.when(i % 103 == 0, "").otherwise(F.concat(F.lit("g"), third.cast("string"))).alias("group"), F.when(i % 10 == 0, "test").when(third % 4 == 0, "validation").otherwise("train").alias("split"),
        F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("prefix_sha256"), "raw", F.sha2("raw", 256).alias("sha"), F.lit("").alias("prefix_sha"),
    )
    rows = manifest._decodes(rows)
    one = [manifest.judge(rows, k).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first")).select(F.lit(k).alias("kind"), "rule", "n", "first") for k in manifest.KINDS]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query()
def q53_route_model_rank(spark, sf_dir):
    """Route models of a bounded sample, over every re-encoded document."""
    rows = variants.codec_variants(table(spark, sf_dir, "documents"), _DETECT_LABELS)
    model, _ = route.fit(rows.select("raw", F.col("label").alias("encoding")), most=1500)
    return route.detect(rows, model)


@query(f"SELECT lang, CAST(sum(n) AS BIGINT) AS grams, count(*) AS docs FROM (SELECT lang, CASE WHEN length(coalesce(text, '')) > 2 THEN length(regexp_replace(substr(coalesce(text, ''), 1, 4096), '\\s+', ' ', 'g')) - 2 ELSE 0 END AS n FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[ßŉǰİ]')) GROUP BY lang")
def q94_trigram_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter(~F.coalesce("text", F.lit("")).rlike("[ßŉǰİ]"))
    return X.trigram_totals(rows, "lang").groupBy("lang").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("docs"))


_PRIOR = "pr AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents)) AS prior FROM documents GROUP BY lang)"


@query(_nb_sql(_T_BIN, 2048) + f", {_PRIOR}, t AS (SELECT s.doc_id, s.lang, s.score * z.n + prior AS score FROM s JOIN z ON z.doc_id = s.doc_id JOIN pr ON pr.lang = s.lang) SELECT doc_id, lang, round(score, 4) AS score FROM t")
def q95_nb_with_priors(spark, sf_dir):
    rows = raws(spark, sf_dir, "lang")
    s = bayes.total_score(rows, bayes.fit(rows, "lang"), bayes.priors(rows, "lang"), "doc_id", "lang")
    return s.select("doc_id", "lang", F.round("score", 4).alias("score"))


@query(_nb_sql("x * 256 + y", 65536) + f""", {_PRIOR}, t AS (SELECT s.doc_id, s.lang, s.score + 0.05 * prior AS score FROM s JOIN pr ON pr.lang = s.lang),
r AS (SELECT doc_id, lang, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM t)
SELECT a.doc_id, CASE WHEN a.score - b.score >= 0.015 THEN a.lang END AS lang, round(1 / (1 + exp(-least(a.score - b.score, 80))), 6) AS confidence FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2""")
def q96_bigram_nb_detect(spark, sf_dir):
    rows = raws(spark, sf_dir, "lang")
    s = bayes.score_objects(rows, bayes.fit(rows, "lang", kind="bigram"), "doc_id", "lang", kind="bigram")
    return bayes.decide(s, bayes.priors(rows, "lang"), "doc_id", "lang").select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


@query()
def q97_engines(spark, sf_dir):
    """Several detectors over the same objects: how many texts each reads right."""
    docs = table(spark, sf_dir, "documents")
    rows = variants.codec_variants(docs, _DETECT_LABELS)
    some = variants.codec_variants(docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).select("doc_id", "text"), _DETECT_LABELS)  # a bounded sample to learn from
    found = engines.compare(rows, {
        "l2": engines.linear(_model(docs, _DETECT_LABELS)), "route": engines.routes(route.fit(some.select("raw", F.col("label").alias("encoding")), full=False)[0]),
        "transition": engines.transitions(bayes.fit(some, "label"), "label"), "structure": engines.structure(),
    }, ["doc_id", "label"])
    truth = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return found.join(truth, "doc_id").groupBy("engine", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text_sha256") == F.col("sha")).alias("right"), F.count_if(F.col("guess").isNull()).alias("abstained"))


@query()
def q98_masked_windows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("utf-8").alias("label"), F.coalesce("html", F.lit("")).cast("binary").alias("raw"))
    return corpus.masked_windows(pages, "raw", "label", 1024).select("doc_id", "window", "sha256")
