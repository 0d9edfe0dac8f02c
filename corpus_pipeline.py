"""A training corpus from ``documents``: five stages, each one of the operators in octaspark.llm.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns
they came with, whatever their names; the last returns packed pieces.
:func:`run` writes every stage's result as Parquet to the shared folder and
reads it again. An empty table goes through all stages as one. Rows are told
apart as rows: doc_ids may be null or repeated.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaspark.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from octaspark.llm.shared import hide, save, show, shrink, small, table


def lean(stage):
    """The stage, begun with executors that hold no more heap than they need: the memory that the stage before took isn't this one's."""

    @wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run_lean


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among ``docs``.

    Repeated rows share a score and go or stay together; null and empty texts
    score lowest and stay.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@lean
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document of which nothing but blanks is left goes with them.

    Null and empty texts lose nothing and stay. Rows that share doc_id and text
    are one document; of equal texts the least doc_id (null first) keeps its
    lines. n_chars follows the text where a text changed.
    """
    rows = hide(docs, "doc_id", "text", "n_chars")
    out = line_dedup.dedup(rows)
    changed = F.col("lines_gone") > 0
    out = out.filter(~changed | F.col("kept_text").rlike(r"\S")).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return show(out.drop("kept_text", "lines_gone"), docs, "doc_id", "text", "n_chars")


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: of its least doc_id, the first row (null ids come last).

    Null and empty texts are like nothing and stay, repeated or not.
    """
    rows, _ = save(hide(docs, "doc_id", "text").withColumn("octa_row", F.monotonically_increasing_id()))
    gone, _ = save(ngram_join.join(rows, row_id="octa_row").filter("NOT keep").select("octa_row"))
    return show(rows.join(small(gone), "octa_row", "left_anti").drop("octa_row"), docs, "doc_id", "text")


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight consecutive words of a benchmark item, or two shorter items, go.

    Null and empty texts hold none and stay; repeated rows go or stay together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of at most 4096 tokens; null texts are empty ones, repeated rows pieces of their own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir))
    return docs
