import corpus_pipeline
from snapscope.llm.common import stored

from tests.llm.cases import documents, odd_texts, prose


def test_stages_keep_columns_and_work_on_what_is_kept(spark):
    docs = documents(spark, odd_texts() + [prose(k, 80) for k in range(30)] + [prose(1, 80)])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_strings", "benchmark_passages", "best_fit_packing"]
    assert docs.count() >= 30


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), "/root/testdata/sf0.001").count() == 0
