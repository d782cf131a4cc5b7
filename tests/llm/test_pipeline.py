"""The pipeline over the smallest tables: stages in order, columns kept, decisions in effect."""
from pyspark.sql import functions as F

from mattone.llm import decontaminate
from mattone.llm.store import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    docs = table(spark, FOLDER, "documents").withColumn("digest", F.col("lang"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) <= before and len({r.doc_id for r in rows}) == len(rows)
        docs, before = spark.createDataFrame(rows, out.schema), len(rows)
    assert decontaminate.contaminated(docs, table(spark, FOLDER, "benchmark")).count() == 0
    assert len({r.text for r in docs.collect()}) == before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == before
