"""The ten operators of this subpackage as registered queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, line_dedup, ngram_join, packing, pii, shards, substring_dedup, toxicity, url_filter
from .shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(table(spark, sf_dir, "documents"))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_jump_shards, op3_toxicity, op4_url_filter, op5_best_fit_packing, op6_decontamination, op7_ngram_join, op8_line_dedup, op9_pii, op10_fingerprints)
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every window of every item against every window of the same number of words of every document.
OP6_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM pat),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, sizes WHERE len(w) >= m)
),
hit AS (SELECT doc_id, item_id, i, m FROM win JOIN pat USING (m, p)),
place AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: All pairs that share a shingle, their exact similarity, and connected classes by recursion.
OP7_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, coalesce(least(doc_id, (SELECT min(y) FROM reach WHERE x = doc_id)), doc_id) AS class_id,
       CAST((SELECT count(*) FROM link WHERE x = doc_id) AS BIGINT) AS n_links
FROM doc
"""

ORACLE_SQL = {"op4_url_filter": url_filter.ORACLE, "op6_decontamination": OP6_SQL, "op7_ngram_join": OP7_SQL}
