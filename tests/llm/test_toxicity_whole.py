"""Toxicity is learned from all labelled documents, in shards."""

import numpy as np
from pyspark.sql import functions as F

from cladeframe.llm import toxicity
from cladeframe.llm.toxicity import BUCKETS, WordConv
from cladeframe.llm.words import crc_fold

DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def tables(spark, rows):
    """Documents and labels of (doc_id, text, lang, label)."""
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS)


def test_long_texts_are_learned_from(spark):
    """Texts of one class are longer than 32 kB."""
    rows = [(i, "fine day " * 4000 + "vile" if i % 3 == 0 else f"fine day {i}", "en", int(i % 3 == 0)) for i in range(90)]
    docs, labels = tables(spark, rows)
    model = toxicity.train_toxicity(docs, labels)
    assert model.trained
    asked = spark.createDataFrame([(1, "a vile day", "en"), (2, "a fine day", "en")], DOCS)
    score = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(asked, model).collect()}
    assert score[1] > score[2]


def test_every_labelled_document_counts_once_in_any_number_of_shards(spark):
    rng = np.random.default_rng(2)
    rows = [
        (i, " ".join(f"w{k}" for k in rng.integers(0, 400, 12)) + (" rude" if i % 2 else " kind"), ["en", None][i % 2], i % 2)
        for i in range(4000)
    ]
    rows[7] = (7, None, None, 1)
    docs, labels = tables(spark, rows)
    known = labels.where(crc_fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    learnable = toxicity._learnable(docs.unionByName(docs.limit(50)), known)
    assert learnable.count() == known.count() > 2 * 1500
    seen = []
    for parts in (1, 6):
        shards = toxicity.stage(toxicity._dealt(learnable, parts), by="shard")
        assert shards.where("packed is not null").count() == parts
        total = toxicity._total(shards, lambda s: (1, WordConv.seen_in(s.pairs, s.starts, s.y)))
        seen.append(np.rint(total * parts).reshape(2, -1))
    assert (seen[0] == seen[1]).all()
    # The word that all texts of one label have tells how many there are to learn from, in both tables.
    of_rude = learnable.where("not rest and label = 1 and size(words) > 0").count()
    hashed = docs.limit(1).select(F.xxhash64(F.lit("rude")).alias("h")).first()["h"]
    at = WordConv.buckets(np.array([hashed]))[0]
    assert at[0] < BUCKETS <= at[1] and (seen[0][0][at] >= of_rude).all() and of_rude > 1500 * 0.8


def test_shards_learn_together(spark):
    rows = [(i, f"this is a {'rude' if i % 4 == 0 else 'kind'} word {i % 17}", "en", int(i % 4 == 0)) for i in range(900)]
    docs, labels = tables(spark, rows)
    model = toxicity.train_toxicity(docs, labels, shard_texts=200)
    again = toxicity.train_toxicity(docs, labels, shard_texts=200)
    assert (model.flat() == again.flat()).all() and model.thresholds == again.thresholds
    assert set(model.thresholds) == {None, "en"}
    scored = toxicity.with_toxicity(docs, model).join(labels, "doc_id")
    wrong = scored.where((F.col("score") >= 0.5).cast("int") != F.col("toxic"))
    assert wrong.count() == 0
