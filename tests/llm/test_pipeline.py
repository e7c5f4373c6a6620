"""The pipeline's stages one after another on the smallest tables."""

import corpus_pipeline
from quillgraph.llm import jaccard_join, quality_rules, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, DATA)
        found.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i == 0:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
        elif i == 1:
            want = {r.component_id for r in jaccard_join.similar_components(docs).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        elif i == 2:
            want = {r.doc_id: r.kept.decode("utf-8", "ignore") for r in suffix_dedup.suffix_dedup(docs).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == {k: v for k, v in want.items() if v}
        else:
            assert after.select("doc_id").distinct().count() == docs.count()
            break
        assert after.columns == columns and 0 < after.count() <= n
        docs, n = after, after.count()
