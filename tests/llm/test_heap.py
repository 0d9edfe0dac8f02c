"""No stage of the pipeline begins with the heap that the one before took."""

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_begin_with_a_collected_heap(spark):
    # in local mode the executor is the driver's JVM; these collections give heap back and are counted apart from small ones
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)  # nothing runs but its beginning
    assert full() > before


def test_every_stage_does():
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
