"""Every stage of the pipeline over the smallest tables."""

import corpus_pipeline
from ampliform.llm import exact_dedup, jaccard_join


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = seen[name] = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert exact_dedup.decisions(seen["exact_dedup"]).where("not kept").count() == 0
    assert jaccard_join.join_classes(seen["near_dedup"]).where("doc_id <> component_id").count() == 0
    assert seen["bpe"].count() == seen["mixing"].count()
    assert corpus_pipeline.run(spark, sf).count() == seen["bpe"].count()
