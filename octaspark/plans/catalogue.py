"""Registered queries of the byte and text-encoding engine, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import bytesql as B
from ..functions import features as X
from ..operators import bayes, corpus, detect, evaluate, html, model
from ..schemas import PREFIX, SIGNATURES
from ..sources import variants

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raws(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *more, F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decisive byte rules say of every document in every Unicode encoding."""
    rows = variants.unicode_variants(table(spark, sf_dir, "documents"))
    raw = F.col("raw")
    guess = F.coalesce(B.bom_encoding(raw), B.utf32_lanes(raw), B.utf16_parity(raw), F.when(B.strong_utf8(raw), "utf-8"))
    return rows.groupBy("label", guess.alias("guess"), B.signals(raw)["route"].alias("route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(B.printable_ascii(raw)).alias("printable"))


#: A document's bytes as hexadecimal, and as a list of numbers.
HX = "hex(encode(coalesce(text, '')))"
LIST = "list_transform(regexp_extract_all({0}, '..'), lambda h: CAST('0x' || h AS INTEGER))"
NUMS = LIST.format(HX)
PRE = LIST.format(f"substr({HX}, 1, {2 * PREFIX})")
_BOM = " ".join(f"WHEN starts_with({{0}}, '{h}') THEN '{label}'" for h, label in SIGNATURES)


def bom_case(hx: str) -> str:
    return "CASE " + _BOM.format(hx) + " END"


_FRONTS = ("", "EFBBBF", "FEFF", "FFFE", "FFFE0000", "0000FEFF")


@query(f"""SELECT doc_id, front, {bom_case("front || " + HX)} AS encoding, CAST(octet_length(encode(coalesce(text, ''))) + length(front) // 2 AS BIGINT) AS n_bytes
FROM documents, (VALUES {", ".join(f"('{f}')" for f in _FRONTS)}) t(front)""")
def q01_bom_inspect(spark, sf_dir):
    rows = raws(spark, sf_dir).select("doc_id", "raw", F.explode(F.array(*[F.lit(f) for f in _FRONTS])).alias("front"))
    raw = F.concat(F.unhex("front"), "raw")
    return rows.select("doc_id", "front", B.bom_encoding(raw).alias("encoding"), F.length(raw).cast("long").alias("n_bytes"))


_CASES = sorted({h[:n] for h, _ in SIGNATURES for n in range(0, len(h) + 1, 2)} | {"61", "FF80", "EFBB00", "FFFE41"})


@query(f"""WITH c AS (SELECT hx, final FROM (VALUES {", ".join(f"('{x}')" for x in _CASES)}) a(hx), (VALUES (true), (false)) b(final)),
w AS (SELECT *, NOT final AND hx <> '' AND ({" OR ".join(f"(starts_with('{h}', hx) AND length(hx) < {len(h)})" for h, _ in SIGNATURES)}) AS incomplete FROM c)
SELECT hx, final, CASE WHEN incomplete THEN NULL ELSE {bom_case("hx")} END AS encoding, incomplete FROM w""")
def q02_bom_incomplete_prefix(spark, sf_dir):
    rows = spark.createDataFrame([(x, f) for x in _CASES for f in (True, False)], "hx string, final boolean").withColumn("e", B.inspect_bom(F.unhex("hx"), F.col("final")))
    return rows.select("hx", "final", "e.encoding", "e.incomplete")


_CUTS = (1, 2, 3, 5, 17, 100, 1000, 4096)


@query(f"""SELECT doc_id, k, try(decode(unhex(substr({HX}, 1, 2 * k)))) IS NOT NULL AS valid FROM documents, (VALUES {", ".join(f"({k})" for k in _CUTS)}) t(k)""")
def q03_utf8_validity(spark, sf_dir):
    rows = raws(spark, sf_dir).select("doc_id", "raw", F.explode(F.array(*[F.lit(k) for k in _CUTS])).alias("k"))
    return rows.select("doc_id", "k", B.is_utf8(F.substr("raw", F.lit(1), F.col("k"))).alias("valid"))


@query(f"""WITH b AS (SELECT doc_id, substr({HX}, 1, {2 * PREFIX}) AS p FROM documents),
c AS (SELECT doc_id, p, {LIST.format("p")} AS l, try(decode(unhex(p))) IS NOT NULL AS strict FROM b),
d AS (SELECT doc_id, strict, list_contains(l, 0) AS nul, CAST(len(list_filter(l, lambda x: x >= 128)) AS BIGINT) AS high, CAST(len(l) AS BIGINT) AS n FROM c)
SELECT *, CASE WHEN strict THEN 'U' WHEN nul THEN 'N' WHEN high <= CAST(0.02 AS DOUBLE) * greatest(n, 1) THEN 'RL' ELSE 'RH' END AS route FROM d""")
def q04_byte_signals_route(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", B.signals(F.col("raw")).alias("s")).select("doc_id", "s.strict", "s.nul", "s.high", "s.n", "s.route")


_CTL = "regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]')"
_NONASCII = "CAST(length(regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]', '', 'g')) AS BIGINT)"


@query(f"""SELECT doc_id, {_NONASCII} AS non_ascii, {_CTL} AS controls,
octet_length(encode(coalesce(text, ''))) >= 64 AND {bom_case(HX)} IS NULL AND NOT {_CTL} AND {_NONASCII} >= 3 AS strong FROM documents""")
def q05_strong_utf8_evidence(spark, sf_dir):
    raw = F.col("raw")
    return raws(spark, sf_dir).withColumn("e", B.utf8_evidence(raw)).select("doc_id", "e.non_ascii", "e.controls", B.strong_utf8(raw).alias("strong"))


@query(f"""SELECT 'documents' AS source, doc_id AS id, octet_length(encode(coalesce(text, ''))) BETWEEN 1 AND 4096 AND regexp_full_match(coalesce(text, ''), '[\\t\\n\\r -~]+') AS printable FROM documents
UNION ALL SELECT 'pages', page_id, octet_length(encode(coalesce(html, ''))) BETWEEN 1 AND 4096 AND regexp_full_match(coalesce(html, ''), '[\\t\\n\\r -~]+') FROM pages""")
def q06_printable_ascii(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).cast("binary").alias("raw"))
    rows = raws(spark, sf_dir).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "raw").unionByName(pages)
    return rows.select("source", "id", B.printable_ascii(F.col("raw")).alias("printable"))


_NAMES = ("utf-8", "UTF_16", "cp1252", "windows-1251", "cp874", "iso8859-1", "latin1", "gb18030", "big5", "euc_jp", "shift_jis", "cp949", "iso2022_jp", "hz", "koi8-r", "ascii", "mac_roman", "cp437", "johab")


@query(f"""SELECT label, CASE WHEN v LIKE 'utf%' THEN 'utf' WHEN regexp_matches(v, '^(cp125|windows-125|cp874)') THEN 'singlebyte-win' WHEN regexp_matches(v, '^(iso8859|iso-8859|latin)') THEN 'singlebyte-iso'
WHEN regexp_matches(v, '^(gb|big5|euc|shift|cp932|cp949|johab|iso2022|hz|cp950)') THEN 'cjk' WHEN v LIKE 'koi8%' THEN 'koi8' WHEN v = 'ascii' THEN 'ascii' ELSE 'other' END AS family
FROM (SELECT label, replace(lower(label), '_', '-') AS v FROM (VALUES {", ".join(f"('{x}')" for x in _NAMES)}) t(label))""")
def q07_codec_family(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _NAMES], "label string").select("label", B.family(F.col("label")).alias("family"))


@query(f"SELECT doc_id, CAST(len(list_filter({NUMS}, lambda x: x BETWEEN 128 AND 159)) AS BIGINT) AS n FROM documents")
def q08_c1_control_count(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", B.c1_count(B.latin1(F.col("raw"))).cast("long").alias("n"))


@query(f"SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha256, sha256(unhex(substr({HX}, 1, {2 * PREFIX}))) AS prefix_sha256 FROM documents")
def q09_content_digest(spark, sf_dir):
    d = corpus.digests(F.col("raw"))
    return raws(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in d.items()])


@query(f"""SELECT doc_id, prefix_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY prefix_sha256 ORDER BY doc_id) AS r FROM
(SELECT doc_id, sha256(unhex(substr({HX}, 1, {2 * PREFIX}))) AS prefix_sha256 FROM documents)) WHERE r = 1""")
def q10_prefix_first_seen(spark, sf_dir):
    return corpus.first_seen(raws(spark, sf_dir).select("doc_id", corpus.digests(F.col("raw"))["prefix_sha256"].alias("prefix_sha256")), ["prefix_sha256"], ["doc_id"])


@query("""SELECT source, count(*) AS n, CAST(CAST('0x' || substr(sha256(source), 1, 12) AS BIGINT) % 3 AS INTEGER) AS fold3,
CAST(list_sum(list_transform(regexp_extract_all(sha256(source), '..'), lambda h: CAST('0x' || h AS INTEGER))) % 5 AS INTEGER) AS fold5 FROM documents GROUP BY source""")
def q11_group_hash_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", B.fold3(F.col("source")).alias("fold3"), B.fold5(F.col("source")).alias("fold5"))


@query(f"""SELECT doc_id, sha256(unhex(CASE WHEN n <= 768 THEN hx ELSE substr(hx, 1, 512) || substr(hx, 2 * (n // 2 - 128) + 1, 512) || substr(hx, 2 * n - 511, 512) END)) AS sample_sha256, least(n, 768) AS n
FROM (SELECT doc_id, {HX} AS hx, CAST(length({HX}) // 2 AS BIGINT) AS n FROM documents)""")
def q12_hmt_sample(spark, sf_dir):
    s = B.hmt768(F.col("raw"))
    return raws(spark, sf_dir).select("doc_id", F.sha2(s, 256).alias("sample_sha256"), F.length(s).cast("long").alias("n"))


@query(f"""WITH d AS (SELECT doc_id, {HX} AS hx FROM documents), w AS (SELECT doc_id, k AS "window", substr(hx, 2 * CASE k WHEN 0 THEN 0 WHEN 1 THEN length(hx) // 2 // 3 ELSE length(hx) // 3 END + 1, 16384) AS p FROM d, (VALUES (0), (1), (2)) t(k))
SELECT doc_id, "window", CAST(length(p) // 2 AS BIGINT) AS n, sha256(unhex(p)) AS sha256 FROM w WHERE length(p) >= 256 AND len(list_filter({LIST.format("p")}, lambda x: x >= 128)) > 0""")
def q13_text_windows(spark, sf_dir):
    return corpus.windows(raws(spark, sf_dir), "raw").select("doc_id", "window", F.length("part").cast("long").alias("n"), F.sha2("part", 256).alias("sha256"))


_BLOCKS = f"SELECT doc_id, {{0}} unnest(list_transform(generate_series(0, (length(hx) // 2 - 128) // 64), lambda k: substr(hx, 128 * k + 1, 256))) AS h FROM (SELECT doc_id, source, {HX} AS hx FROM documents) WHERE length(hx) >= 256"


@query(f"SELECT doc_id, count(DISTINCT h) AS n FROM ({_BLOCKS.format('')}) GROUP BY doc_id")
def q14_sampled_blocks(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", F.size(B.blocks(F.col("raw"))).cast("long").alias("n")).filter("n > 0")


_FOLD = "CAST(CAST('0x' || substr(sha256(source), 1, 12) AS BIGINT) % 3 AS INTEGER)"


@query(f"""WITH d AS (SELECT doc_id, {_FOLD} AS fold, sha256(encode(coalesce(text, ''))) AS s FROM documents)
SELECT doc_id FROM d WHERE fold = 0 AND s IN (SELECT s FROM d WHERE fold <> 0)""")
def q15_exact_overlap(spark, sf_dir):
    rows = raws(spark, sf_dir, "source").select("doc_id", B.fold3(F.col("source")).alias("fold"), F.sha2("raw", 256).alias("s"))
    return rows.filter("fold = 0").join(rows.filter("fold <> 0").select("s"), "s", "left_semi").select("doc_id")


@query(f"""WITH b AS (SELECT DISTINCT doc_id, fold, h FROM ({_BLOCKS.format(_FOLD + ' AS fold,')})),
p AS (SELECT x.doc_id, y.doc_id AS other, count(*) AS n FROM b x JOIN b y USING (h) WHERE x.fold = 0 AND y.fold <> 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT doc_id, max(n) AS most, count(*) AS others FROM p GROUP BY doc_id""")
def q16_near_overlap(spark, sf_dir):
    rows = raws(spark, sf_dir, "source").withColumn("fold", B.fold3(F.col("source")))
    pairs = corpus.overlap(rows.filter("fold = 0"), rows.filter("fold <> 0"), "doc_id", "raw")
    return pairs.groupBy("doc_id").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("others"))


#: The normalized view and its n-grams in SQL.
_VIEW = f"""v AS (SELECT doc_id, regexp_replace(lower(coalesce(list_aggregate(list_transform({PRE}, lambda b: chr(b)), 'string_agg', ''), '')), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}]{{2,}}', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, substr(t, i, k) AS gram, count(*) AS tf FROM (SELECT doc_id, t, k, unnest(generate_series(1, length(t) - k + 1)) AS i FROM v, (VALUES (2), (3)) n(k) WHERE length(t) >= k) GROUP BY 1, 2),
c AS (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM g GROUP BY gram)"""


@query(f"WITH {_VIEW} SELECT gram, df, cf FROM c")
def q17_ngram_counts(spark, sf_dir):
    return X.ngram_counts(raws(spark, sf_dir))


@query(f"WITH {_VIEW}, t AS (SELECT * FROM c WHERE df >= 2 ORDER BY cf DESC, gram LIMIT 45000) SELECT CAST(row_number() OVER (ORDER BY gram) - 1 AS INTEGER) AS idx, gram, df, cf FROM t")
def q18_vocabulary(spark, sf_dir):
    return X.vocabulary(X.ngram_counts(raws(spark, sf_dir))).select("idx", "gram", "df", "cf")


@query(f"WITH {_VIEW} SELECT gram, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 6) AS idf FROM c WHERE df >= 2")
def q19_idf(spark, sf_dir):
    rows = raws(spark, sf_dir)
    n = rows.agg(F.count(F.lit(1)).alias("docs"))
    return X.ngram_counts(rows).filter("df >= 2").crossJoin(F.broadcast(n)).select("gram", F.round(X.idf(F.col("df"), F.col("docs")), 6).alias("idf"))


@query(f"""WITH {_VIEW}, k AS (SELECT gram, df FROM c WHERE df >= 2 ORDER BY cf DESC, gram LIMIT 45000), x AS (SELECT doc_id, gram, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM g JOIN k USING (gram)),
y AS (SELECT doc_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM x)
SELECT doc_id, gram, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, gram) AS r FROM y) WHERE r <= 5""")
def q20_tfidf_l2norm(spark, sf_dir):
    """Weighed and normalized where the n-grams are counted, with the bounded vocabulary sent out: nothing is shuffled by document or n-gram pair."""
    rows = raws(spark, sf_dir)
    vocabulary = X.vocabulary(X.ngram_counts(rows)).select("gram", "df")
    return X.tfidf_top(rows, "doc_id", vocabulary, rows.count(), 5)


_PAIRS = f"(SELECT unnest(list_zip(l[:-2], l[2:])) AS p FROM (SELECT {{0}} AS l FROM documents) WHERE len(l) > 1)"


def _bins_sql(expression: str, numbers: str = NUMS) -> str:
    return f"SELECT CAST({expression} AS BIGINT) AS bin, count(*) AS n FROM (SELECT CAST(p[1] AS BIGINT) AS x, CAST(p[2] AS BIGINT) AS y FROM {_PAIRS.format(numbers)}) GROUP BY 1"


@query(f"SELECT CAST(b AS BIGINT) AS bin, count(*) AS n FROM (SELECT unnest({NUMS}) AS b FROM documents) GROUP BY 1")
def q21_byte_histogram(spark, sf_dir):
    return X.bins(raws(spark, sf_dir), "byte")


@query(_bins_sql("(x + y) % 256"))
def q22_byte_sum_bins(spark, sf_dir):
    return X.bins(raws(spark, sf_dir), "sum")


@query(f"SELECT 'difference' AS kind, * FROM ({_bins_sql('(y - x + 256) % 256')}) UNION ALL SELECT 'xor', * FROM ({_bins_sql('xor(x, y) >> 2')})")
def q23_difference_xor_bins(spark, sf_dir):
    rows = raws(spark, sf_dir)
    one = [X.bins(rows, k).select(F.lit(k).alias("kind"), "bin", "n") for k in ("difference", "xor")]
    return one[0].unionByName(one[1])


@query(_bins_sql("xor(x * 131, y * 17) & 511"))
def q24_ordered_bins(spark, sf_dir):
    return X.bins(raws(spark, sf_dir), "ordered")


@query(_bins_sql("((x * 257 + y) * 2654435761) & 2047", PRE))
def q25_transition_bins(spark, sf_dir):
    return X.bins(raws(spark, sf_dir), "transition", cut=PREFIX)


#: Case folding in SQL for the scripts of the tables: lower case, and the sharp s as two letters.
_TRI = "t AS (SELECT doc_id, lang, regexp_replace(replace(lower(substr(coalesce(text, ''), 1, 4096)), 'ß', 'ss'), '\\s+', ' ', 'g') AS t FROM documents), g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram, count(*) AS tf FROM (SELECT doc_id, lang, t, unnest(generate_series(1, length(t) - 2)) AS i FROM t WHERE length(t) >= 3) GROUP BY ALL)"


def _trigram_counts(spark, sf_dir):
    return X.trigram_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {_TRI} SELECT gram, CAST(sum(tf) AS BIGINT) AS n FROM g GROUP BY gram")
def q26_unicode_trigrams(spark, sf_dir):
    return _trigram_counts(spark, sf_dir)


_NB = f"""b AS (SELECT doc_id, lang, CAST({{bin}} AS BIGINT) AS bin, count(*) AS n FROM (SELECT doc_id, lang, CAST(p[1] AS BIGINT) AS x, CAST(p[2] AS BIGINT) AS y FROM
(SELECT doc_id, lang, unnest(list_zip(l[:-2], l[2:])) AS p FROM (SELECT doc_id, lang, {PRE} AS l FROM documents) WHERE len(l) > 1)) GROUP BY ALL),
m AS (SELECT lang, bin, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1, 2), tot AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY 1)"""
_T_BIN, _B_BIN = "((x * 257 + y) * 2654435761) & 2047", "x * 256 + y"


@query(f"WITH {_NB.format(bin=_T_BIN)} SELECT lang, bin, n, round(ln((n + 0.5) / (total + 0.5 * 2048)), 6) AS logp FROM m JOIN tot USING (lang)")
def q27_transition_nb_fit(spark, sf_dir):
    return bayes.fit(raws(spark, sf_dir, "lang"), "lang").select("lang", "bin", "n", F.round("logp", 6).alias("logp"))


def _nb_sql(bin_: str, size: int, numbers: str = PRE) -> str:
    return f"""WITH {_NB.format(bin=bin_).replace(PRE, numbers)}, f AS (SELECT lang, total, ln(0.5 / (total + 0.5 * {size})) AS floor FROM tot),
q AS (SELECT b.doc_id, m.lang, sum(b.n * (ln((m.n + 0.5) / (f.total + 0.5 * {size})) - f.floor)) AS gain FROM b JOIN m USING (bin) JOIN f ON f.lang = m.lang GROUP BY 1, 2),
z AS (SELECT doc_id, sum(n) AS n FROM b GROUP BY 1), s AS (SELECT z.doc_id, f.lang, f.floor + coalesce(gain, 0) / z.n AS score FROM z CROSS JOIN f LEFT JOIN q ON q.doc_id = z.doc_id AND q.lang = f.lang)"""


@query(_nb_sql(_B_BIN, 65536, NUMS) + " SELECT doc_id, lang, round(score, 6) AS score FROM s")
def q28_bigram_nb_score(spark, sf_dir):
    """Over whole texts, for the model and for the scores."""
    rows = raws(spark, sf_dir, "lang")
    return bayes.score_objects(rows, bayes.fit(rows, "lang", kind="bigram", cut=None), "doc_id", "lang", kind="bigram", cut=None).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(_nb_sql(_T_BIN, 2048) + " SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS INTEGER) AS rank FROM s) WHERE rank <= 3")
def q29_nb_rank_top3(spark, sf_dir):
    rows = raws(spark, sf_dir, "lang")
    s = bayes.score_objects(rows, bayes.fit(rows, "lang"), "doc_id", "lang").withColumn("score", F.round("score", 9))
    return bayes.rank(s, "doc_id", "lang").select("doc_id", "lang", "rank")


@query(f"WITH {_TRI} SELECT gram, CAST(sum(tf) AS BIGINT) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 30000")
def q30_language_topk(spark, sf_dir):
    return _trigram_counts(spark, sf_dir).orderBy(F.desc("n"), "gram").limit(30_000)


@query(f"""WITH {_TRI}, k AS (SELECT gram, CAST(sum(tf) AS BIGINT) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 30000), z AS (SELECT ln(sum(n) + 0.5 * (count(*) + 1)) AS total FROM k)
SELECT doc_id, round(sum(tf * (ln(coalesce(n, 0) + 0.5) - total)) / sum(tf), 6) AS score FROM g LEFT JOIN k USING (gram) CROSS JOIN z GROUP BY doc_id HAVING sum(tf) >= 12""")
def q31_language_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return model.language_scores(docs, model.fit_language(X.trigram_counts(docs)), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT doc_id, label, CASE WHEN label = 'utf-8' THEN NULL ELSE label END AS guess FROM documents, (VALUES ('utf-8'), ('utf-8-sig'), ('utf-16')) t(label)),
w AS (SELECT *, coalesce(guess = label, false) AS hit, least(count(*) OVER (PARTITION BY label) - 2, CAST(floor(count(*) OVER (PARTITION BY label) * CAST(0.35 AS DOUBLE)) AS BIGINT)) AS lim,
sum(CASE WHEN guess = label THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY doc_id) AS run FROM v) SELECT doc_id, label FROM w WHERE NOT hit OR run > lim""")
def q32_residual_selection(spark, sf_dir):
    rows = variants.unicode_variants(table(spark, sf_dir, "documents"), ("utf-8", "utf-8-sig", "utf-16"))
    return corpus.residual(rows.select("doc_id", "label", corpus.structural_guess(F.col("raw")).alias("guess")), "label", "guess", "doc_id").select("doc_id", "label")


_MANIFEST = "SELECT CASE WHEN doc_id % 97 = 0 THEN '../' ELSE 'c/' END || doc_id AS path, lang AS encoding, CASE WHEN doc_id % 101 = 0 THEN 'dev' WHEN source < 'src3' THEN 'validation' ELSE 'train' END AS split, CASE WHEN doc_id % 103 = 0 THEN '' ELSE source END AS grp, sha256(encode(coalesce(text, ''))) AS sha FROM documents"


@query(f"""WITH m AS ({_MANIFEST})
SELECT 'empty_field' AS rule, 'group' AS key, count(*) AS n FROM m WHERE grp = '' HAVING count(*) > 0
UNION ALL SELECT 'unknown_split', split, count(*) FROM m WHERE split NOT IN ('train', 'validation', 'test') GROUP BY split
UNION ALL SELECT 'path_escapes', path, count(*) FROM m WHERE path LIKE '../%' GROUP BY path
UNION ALL SELECT 'group_leak', grp, count(DISTINCT split) FROM m GROUP BY grp HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'duplicate_conflict', sha, count(DISTINCT encoding || '/' || split) FROM m GROUP BY sha HAVING count(DISTINCT encoding || '/' || split) > 1""")
def q33_manifest_violations(spark, sf_dir):
    i = F.col("doc_id")
    m = raws(spark, sf_dir, "lang", "source").select(
        F.concat(F.when(i % 97 == 0, "../").otherwise("c/"), i.cast("string")).alias("path"), F.col("lang").alias("encoding"),
        F.when(i % 101 == 0, "dev").when(F.col("source") < "src3", "validation").otherwise("train").alias("split"),
        F.when(i % 103 == 0, "").otherwise(F.col("source")).alias("group"), F.sha2("raw", 256).alias("sha256"),
    )
    return corpus.violations(m)


_EVAL = "SELECT d.doc_id, d.lang, d.source, l.quality = 1 AS old_ok, l.toxic = 0 AS new_ok FROM documents d JOIN labels l USING (doc_id)"


def _eval(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("old_ok"), (F.col("toxic") == 0).alias("new_ok"))


@query(f"SELECT lang, source, count(*) AS n, count(*) FILTER (old_ok) AS hits, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM ({_EVAL}) GROUP BY GROUPING SETS ((lang), (source), ())")
def q34_eval_grouping_sets(spark, sf_dir):
    return evaluate.by_sets(_eval(spark, sf_dir), "lang", "source", "old_ok")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (old_ok) AS old_correct, count(*) FILTER (new_ok) AS new_correct, count(*) FILTER (new_ok AND NOT old_ok) AS helped, count(*) FILTER (old_ok AND NOT new_ok) AS harmed, count(*) FILTER (old_ok = new_ok) AS ties FROM ({_EVAL}) GROUP BY lang")
def q35_paired_helps_harms(spark, sf_dir):
    return evaluate.paired(_eval(spark, sf_dir), ["lang"], "old_ok", "new_ok")


_GUESS = "CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END"


def _language_guess(text):
    return F.when(text.rlike("[ßäöü]"), "de").when(text.rlike("[ñóí]"), "es").when(text.rlike("[éèêç]"), "fr").otherwise("en")


@query(f"SELECT lang, guess, count(*) AS n FROM (SELECT lang, {_GUESS} AS guess FROM documents) WHERE lang <> guess GROUP BY 1, 2 ORDER BY n DESC, lang, guess LIMIT 12")
def q36_confusion_topk(spark, sf_dir):
    return evaluate.confusion(table(spark, sf_dir, "documents").select("lang", _language_guess(F.coalesce("text", F.lit(""))).alias("guess")), "lang", "guess")


@query("""SELECT event_type, n, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median, v[CAST(floor(CAST(0.95 AS DOUBLE) * (n - 1)) AS BIGINT) + 1] AS p95
FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)""")
def q37_latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", "median", "p95")


@query(f"SELECT round(avg(rate) * 100, 2) AS macro, count(*) AS groups FROM (SELECT source, count(*) FILTER (old_ok) / count(*) AS rate FROM ({_EVAL}) GROUP BY source)")
def q38_macro_average(spark, sf_dir):
    return evaluate.macro(_eval(spark, sf_dir), "source", "old_ok")


@query("SELECT doc_id, lang, source, fold FROM documents JOIN (SELECT lang, source, CAST((row_number() OVER (PARTITION BY lang ORDER BY source) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT lang, source FROM documents)) USING (lang, source)")
def q39_stratified_round_robin(spark, sf_dir):
    return corpus.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source").select("doc_id", "lang", "source", "fold")


@query("SELECT lang, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('20261015:' || doc_id)) AS rank FROM documents) WHERE rank <= 8")
def q40_balanced_hash_sample(spark, sf_dir):
    key = F.sha2(F.concat(F.lit("20261015:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return corpus.balanced_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", key)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 12 = 0")
def q41_stride_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.numbered(rows, "doc_id", "lang").filter("place % 12 = 0").select("doc_id")


@query(f"""WITH {_TRI}, a AS (SELECT gram, CAST(sum(tf) AS BIGINT) AS n FROM g WHERE lang = 'en' GROUP BY 1), b AS (SELECT gram, CAST(sum(tf) AS BIGINT) AS n FROM g WHERE lang <> 'en' GROUP BY 1)
SELECT CASE WHEN a.gram IS NULL THEN 'right' WHEN b.gram IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS grams, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS left_n, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS right_n, max(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS most
FROM a FULL OUTER JOIN b ON a.gram = b.gram GROUP BY 1""")
def q42_vocabulary_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one, two = (X.trigram_counts(docs.filter(c)).withColumnRenamed("n", n) for c, n in (("lang = 'en'", "a"), ("lang <> 'en'", "b")))
    both = one.join(two, "gram", "full_outer")
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("grams"), F.sum(a).alias("left_n"), F.sum(b).alias("right_n"), F.max(F.abs(a - b)).alias("most"))


@query("""WITH c AS (SELECT * FROM (VALUES ('src0', 'crawl', 'open'), ('src1', 'books', 'licensed'), ('src2', 'forum', 'open')) t(source, origin, rights))
SELECT source, count(*) AS n, coalesce(any_value(origin), 'unknown') AS origin, any_value(rights) IS NULL AS missing FROM documents LEFT JOIN c USING (source) GROUP BY source""")
def q43_catalog_join(spark, sf_dir):
    lines = spark.createDataFrame([(0, "# catalog"), (1, "| file | source | rights |"), (2, "| `src0` | crawl | open |"), (3, "| `src1` | books | licensed |"), (4, "| `src2` | forum | open |")], "line_no int, text string")
    known = corpus.catalog(lines).select(F.regexp_replace("path", "^catalog/", "").alias("source"), F.col("source").alias("origin"), F.col("provenance").alias("rights"))
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(known), "source", "left").select("source", "n", F.coalesce("origin", F.lit("unknown")).alias("origin"), F.col("rights").isNull().alias("missing"))  # three rows are broadcast


@query("""WITH a AS (SELECT DISTINCT lang AS v FROM documents), b AS (SELECT * FROM (VALUES ('en'), ('de'), ('it')) t(v))
SELECT 'both' AS side, v FROM (SELECT v FROM a INTERSECT SELECT v FROM b) UNION ALL SELECT 'extra', v FROM (SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL SELECT 'missing', v FROM (SELECT v FROM b EXCEPT SELECT v FROM a)""")
def q44_label_drift(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("v")).distinct()
    b = spark.createDataFrame([("en",), ("de",), ("it",)], "v string")
    sides = {"both": a.intersect(b), "extra": a.subtract(b), "missing": b.subtract(a)}
    one, two, three = (df.select(F.lit(k).alias("side"), "v") for k, df in sides.items())
    return one.union(two).union(three)


@query(f"""SELECT page_id, lower(regexp_extract(coalesce(list_aggregate(list_transform({LIST.format("substr(hex(encode(coalesce(html, ''))), 1, 2048)")}, lambda b: chr(b)), 'string_agg', ''), ''), '(?i)<meta\\b[^>]{{0,256}}?charset\\s*=\\s*["'']?\\s*([A-Za-z0-9_.:-]+)', 1)) AS charset FROM pages""")
def q45_html_meta_charset(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", B.meta_charset(F.coalesce("html", F.lit("")).cast("binary")).alias("charset"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(h, '<[A-Za-z/!?][^<>]*>')) AS BIGINT) AS tags, md5(regexp_replace(h, '<[A-Za-z/!?][^<>]*>', ' ', 'g')) AS masked_md5 FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""")
def q46_html_tag_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", html.mask_tags(F.coalesce("html", F.lit(""))).alias("m"))
    return rows.select("page_id", "m.tags", F.md5(F.col("m.masked").cast("binary")).alias("masked_md5"))


_HEADERS = ("", "text/html; charset=windows-1251", "text/html", "application/json; charset=gbk")


@query()
def q47_html_precedence(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("raw"), F.explode(F.array(*[F.lit(h) for h in _HEADERS])).alias("header"))
    return html.decode_html(rows, transport="header").select("page_id", "header", "encoding", "source", "used_replacement", "meta", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"SELECT threshold, count(*) AS n, count(*) FILTER (octet_length(encode(coalesce(text, ''))) >= 64 AND NOT {_CTL} AND {_NONASCII} >= threshold) AS rescued FROM documents, (VALUES (1), (2), (3), (5), (10)) t(threshold) GROUP BY threshold")
def q48_threshold_counterfactual(spark, sf_dir):
    rows = raws(spark, sf_dir)
    own = rows.select(F.when(B.strong_utf8(F.col("raw"), 0), B.utf8_evidence(F.col("raw"))["non_ascii"]).otherwise(-1).alias("k"))
    return own.select(F.explode(F.array(*[F.lit(t) for t in (1, 2, 3, 5, 10)])).alias("threshold"), "k").groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= F.col("threshold")).alias("rescued"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'no_decoded_text' WHEN doc_id % 5 = 1 THEN 'bom_only' WHEN doc_id % 5 = 2 THEN CASE WHEN contains(coalesce(text, ''), chr(10)) THEN 'newline_only' ELSE 'correct' END WHEN doc_id % 5 = 3 THEN 'different_text' ELSE 'correct' END AS kind FROM documents) GROUP BY kind""")
def q49_mismatch_kind(spark, sf_dir):
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    got = F.when(i == 0, F.lit(None)).when(i == 1, F.concat(F.lit("﻿"), t)).when(i == 2, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(i == 3, F.concat(t, F.lit("x"))).otherwise(t)
    return table(spark, sf_dir, "documents").select(evaluate.mismatch(got, t).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _model(docs: DataFrame, labels: tuple[str, ...], most: int = 1500):
    """A model of a bounded sample: the documents with the least hashes, re-encoded; no other bytes are moved."""
    some = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(-(-most // len(labels)))
    rows = variants.codec_variants(some.select("doc_id", "text"), labels)
    return model.fit_linear(rows.select("raw", F.col("label").alias("encoding")).dropDuplicates(["raw"]), most=most, epochs=6)


_DETECT_LABELS = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le", "cp1252", "cp437", "mac_roman")


@query()
def q50_detect_end_to_end(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = detect.detect(variants.codec_variants(docs, _DETECT_LABELS), _model(docs, _DETECT_LABELS)).select("doc_id", "label", "detection.*")
    return found.select("doc_id", "label", "encoding", "candidates", "bom_encoding", "bom_present", "ambiguous", "reason", "accepted", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query()
def q51_decodable_codecs(spark, sf_dir):
    return detect.decodable(variants.codec_variants(table(spark, sf_dir, "documents"), _DETECT_LABELS), list(_DETECT_LABELS))


@query()
def q52_c1_ambiguity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), ("iso8859-1", "cp1252", "utf-8", "cp437")
    found = detect.detect(variants.codec_variants(docs, labels), _model(docs, labels), diagnose=True)
    return found.select("doc_id", "label", "detection.encoding", "ambiguity.warning", "ambiguity.reason", "ambiguity.alternatives")


@query()
def q54_grouped_cv_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("fold", B.fold3(F.col("source")))
    out = None
    for k in range(3):
        train, test = docs.filter(F.col("fold") != k), docs.filter(F.col("fold") == k)
        if train.isEmpty():
            continue
        own = detect.detect(variants.codec_variants(test, _DETECT_LABELS), _model(train, _DETECT_LABELS))
        own = own.select(F.lit(k).alias("fold"), "label", F.coalesce(F.col("detection.encoding") == F.col("label"), F.lit(False)).alias("ok"), F.col("detection.encoding").isNull().alias("unknown"))
        own = own.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok")).alias("correct"), F.count_if(F.col("unknown")).alias("unknown"))
        out = own if out is None else out.unionByName(own)
    return out
