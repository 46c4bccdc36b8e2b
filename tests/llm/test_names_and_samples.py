"""Columns of the caller that bear inner names, ids that many rows share, characters that are cut."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import cladeframe.llm as llm
from cladeframe.llm import language, quality, samples, toxicity
from cladeframe.llm.decontamination import decontaminate
from cladeframe.llm.substrings import dedup_substrings
from cladeframe.llm.suffixes import dedup_bytes
from cladeframe.llm.toxicity import WordConv

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = " ".join(f"word{i}" for i in range(80))
# Every name with `_` in front that stands in the subpackage.
INNER = sorted(
    {n for p in Path(llm.__file__).parent.glob("*.py") for n in re.findall(r'"(_[a-z_]+)"', p.read_text())} - {"__main__"}
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, PASSAGE if i < 2 else f"text number {i}", "en", "a", 5) for i in range(6)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def crowded(docs):
    """The documents with a column of every inner name, some in capitals."""
    return docs.select("*", *[F.lit(f"own {n}").alias(n.upper() if k % 5 == 0 else n) for k, n in enumerate(INNER)])


def check(found, crowded):
    assert set(crowded.columns) <= set(found.columns)
    for row in found.collect():
        assert all(row[c] == f"own {c.lower()}" for c in crowded.columns if c.startswith("_"))


def test_inner_names_are_the_callers(spark, crowded):
    assert {"_spans", "_cut", "_bad", "_found", "_letters"} <= set(INNER)
    check(dedup_bytes(crowded), crowded)
    check(dedup_substrings(crowded, cells=1 << 18), crowded)
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    left = decontaminate(crowded, benchmark)
    check(left, crowded)
    assert left.count() == 4
    model = language.train_language(crowded.where("doc_id < 4").withColumn("lang", F.lit("en")))
    check(language.with_language(crowded, model), crowded)


def test_stages_leave_columns_alone(spark, crowded, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i % 2)) for i in range(6)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, step in pipeline.STAGES[:-1]:
        found = step(spark, crowded, str(tmp_path))
        assert found.columns == crowded.columns, name
        check(found, crowded)


def test_one_id_on_most_rows(spark):
    """Every class is picked in full, ids once each, and no more rows are fetched than ids."""
    rows = [(7, f"text {i}", "en") for i in range(15_000)] + [(i, f"text {i}", "en") for i in range(10_000, 15_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(i, int(i % 2)) for i in range(10_000, 15_000)] + [(7, 1)] * 500
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    picked, share = samples.labelled(docs, labels, "quality", 5, 0)
    assert sorted(picked.values()).count(1) == sorted(picked.values()).count(0) == 1500
    assert 0.45 < share < 0.55
    fetched = samples.one_each(docs, picked, ["text"])
    assert fetched.count() == len(picked) == fetched.select("doc_id").distinct().count()
    # Whatever rows repeat an id, the smallest text stands for it.
    again = samples.one_each(docs, {7: 1}, ["text"]).collect()
    assert [(r["doc_id"], r["_class"], r["text"]) for r in again] == [(7, 1, "text 0")]


def test_many_languages_stay_bounded(spark):
    rows = [(i, f"some text {i}", f"l{i % 300}" if i % 2 else "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train_language(docs, most_languages=3, most_texts=60)
    assert len(model.languages) == 3 and "en" in model.languages


def test_long_texts_are_learned_from_if_asked(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} " * 20_000, "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int")
    assert samples.labelled(docs, labels, "quality", 5, 0)[0] == {}
    assert samples.labelled(docs, labels, "quality", 5, 0, longest=200_000)[0]


def test_each_width_starts_with_its_own_signs():
    model = WordConv(0.5)
    model.out = np.where(np.arange(len(model.out)) % 3 == 0, -1.0, 1.0).astype(np.float32)
    y = np.array([0, 1], np.float32)
    model._seed_embedding(np.zeros((4, 2), np.int64), np.array([0, 2, 4]), y)
    for i, filters in enumerate(model.filters):
        own = model.out[i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS]
        assert (np.sign(filters[:, :: toxicity.DIM]) == np.sign(own)[:, None]).all()


def test_characters_are_not_cut(spark):
    """Two texts share a passage after letters whose last byte is the same."""
    rows = [(1, "vor ü" + PASSAGE + "ä nach"), (2, "pirms ļ" + PASSAGE + "Ĥ pēc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    by_bytes = {r["doc_id"]: bytes(r["kept"]) for r in dedup_bytes(docs).collect()}
    whole = {r["doc_id"]: bytes(r["kept"]) for r in dedup_bytes(docs, whole_characters=True).collect()}
    assert by_bytes[1] == whole[1] == rows[0][1].encode()
    with pytest.raises(UnicodeDecodeError):
        by_bytes[2].decode()
    assert whole[2].decode() in ("pirms  pēc", "pirms Ĥ pēc")


def score_by_loops(model, text):
    """The byte network's score of one text, position by position."""
    return float(model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def test_scores_do_not_depend_on_neighbours(spark):
    """A text scores the same alone and between others, across slabs of positions too."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 3, 40, 700, 9000, 150_000, 2)]
    y = np.array([0, 1] * 4, np.float32)
    model = quality.ByteConv(0.5)
    model.fit(texts[:6], y[:6], np.ones(6, np.float32))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = model.score(flat, starts)
    assert np.allclose(together, [score_by_loops(model, t) for t in texts], atol=1e-5)
