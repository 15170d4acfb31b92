"""The pipeline's stages one by one: each keeps whole rows and does what it says."""

from corpus_pipeline import STAGES, run
from scenemill.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = staged(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        if name == "exact dedup":
            assert docs.count() == docs.select("text").distinct().count()
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in run(spark, FOLDER).select("doc_id").collect()) == ids
