"""The pipeline's last stage on rows without an id and rows that share one."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cladeframe.llm.mixing import mix, mixed

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rows_are_not_known_by_id(spark):
    ids = [None] * 5 + [7] * 6 + [8, 8] + list(range(20, 40))
    texts = [" ".join([f"w{i}"] * (20 + i)) for i in range(len(ids))]
    texts[3] = texts[2]
    rows = [(d, t, "en", "ab"[i % 2], len(t)) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = pipeline.mixing(spark, docs, "")
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    found = out.collect()
    want = mix(docs).where("taken > 0").collect()
    some = lambda rows: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rows)
    assert some(found) == some(want)
    assert not Counter(tuple(r)[:5] for r in found) - Counter(rows)
    assert all(r["size"] == len(r["text"].split()) for r in found)
    words = sum(len(t.split()) for t in texts)
    assert words - 32 <= sum(r["taken"] for r in found) <= words
    assert {None, 7, 8} <= {r["doc_id"] for r in found}
    again = mixed(docs.withColumns({"taken": F.lit("x"), "size": F.lit("x")})).drop("text").collect()
    assert some(again) == some(want)
    assert mixed(docs.limit(0)).count() == 0
