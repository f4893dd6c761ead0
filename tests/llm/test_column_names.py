"""Stages of the pipeline pass columns of any name."""

import corpus_pipeline
from tests.llm.helpers import documents, sample_texts


def test_stages_pass_dotted_and_quoted_names(spark, tmp_path):
    docs = documents(spark, sample_texts()).withColumnsRenamed({"lang": "meta.lang", "source": "odd`name"})
    spark.createDataFrame([(1, "q w e r t y u i o p")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.count() > 0, name
