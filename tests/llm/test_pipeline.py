"""The corpus pipeline and the registered queries with SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from octaspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    plain = lambda df: sorted((tuple(None if v is None or v != v else str(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
    assert sorted(got.columns) == cols and plain(got) == plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
