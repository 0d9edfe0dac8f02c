"""The near-duplicate stage on repeated rows and null doc_ids."""

import corpus_pipeline


def test_repeated_rows_and_null_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (4, text(4)), (5, text(4)), (5, text(5)), (6, None), (6, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (4, text(4)), (5, text(5)), (6, None), (6, None), (None, "")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
