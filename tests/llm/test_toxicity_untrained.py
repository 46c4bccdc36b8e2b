"""The toxicity stage where nothing can be learned."""

import pytest

import corpus_pipeline as pipeline
from cladeframe.operators.staging import fresh_path

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(i, 1, 1) for i in range(40)], [(i, 1, 0) for i in range(40)], [(1, 1, None)]])
def test_all_documents_stay(spark, labels):
    path = fresh_path(spark)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    rows = [(i, f"some text {i}", "en", "a", 11) for i in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = pipeline.toxicity(spark, docs, path)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
