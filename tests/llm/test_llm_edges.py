"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import language, quality, toxicity
from cladeframe.llm.decontamination import contaminated, decontaminate
from cladeframe.llm.mixing import mix
from cladeframe.llm.near_vectors import near_vectors
from cladeframe.llm.set_join import set_join
from cladeframe.llm.substrings import dedup_substrings
from cladeframe.llm.suffixes import dedup_bytes
from cladeframe.llm.token_counts import with_bpe_count, with_word_count

DOCS = """doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size string,
kept string, n_words string, taken string, tokens string, words string, gram string, component string, _n string"""
PASSAGE = " ".join(f"word{i}" for i in range(80))
LONG = " ".join(f"long{i % 5000} é" for i in range(60_000))
TEXTS = [
    (1, PASSAGE, "en", "a"),
    (2, PASSAGE, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", "en", "b"),
    (6, "one two", "en", "b"),
    (7, "one two", None, "b"),
    (8, LONG, "en", None),
    (9, "1234 -- !!", "en", ""),
    (None, PASSAGE, "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, None, *["x"] * 10) for t in TEXTS]
    return spark.createDataFrame(rows, DOCS).coalesce(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_classifiers(docs, labels):
    for model, scored in (
        (quality.train_quality(docs, labels.limit(0)), quality.with_quality),
        (toxicity.train_toxicity(docs, labels.limit(0)), toxicity.with_toxicity),
    ):
        found = scored(docs, model).select("doc_id", "score").collect()
        assert len(found) == len(TEXTS)
        assert {r["score"] for r in found} == {0.5}
        assert scored(docs.limit(0), model).count() == 0
    fitted = quality.ByteConv().fit([b"good text here", b"BAD!!"] * 8, _array([1, 0] * 8), _array([1] * 16))
    found = quality.with_quality(docs, fitted).select("doc_id", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4)}) == 1


def _array(values):
    import numpy as np

    return np.array(values, np.float32)


def test_language(docs):
    one = language.train_language(docs.where("lang is not null"))
    found = by_id(language.with_language(docs, one))
    assert {i: r["lang_pred"] for i, r in found.items()} == {
        1: "en", 2: "en", 3: "und", 4: "und", 5: "und", 6: "en", 7: "en", 8: "en", 9: "und", None: "en",
    }
    none = language.train_language(docs.where("false"))
    assert {r["lang_pred"] for r in language.with_language(docs, none).collect()} == {"und"}


def test_mix(docs):
    found = by_id(mix(docs))
    assert set(found) == {t[0] for t in TEXTS}
    assert found[3]["size"] == 0 and found[3]["taken"] == 0
    # Null is a source of its own and comes last: weights "" 1, a 2, b 3, null 1.
    assert found[8]["source_size"] == 120_000
    assert found[4]["target"] == found[4]["source_size"] * 3
    assert all(r["taken"] <= 3 * r["size"] for r in found.values())
    assert mix(docs.limit(0)).count() == 0


def test_set_join(docs):
    found = by_id(set_join(docs))
    assert (found[2]["class_id"], found[2]["n_links"], found[2]["kept"]) == (1, 1, False)
    assert (found[7]["class_id"], found[7]["n_links"], found[7]["kept"]) == (6, 1, False)
    for i in (3, 4, 5, 8, 9):
        assert (found[i]["n_links"], found[i]["kept"]) == (0, True)
    assert found[None]["kept"] and found[None]["n_links"] == 0
    assert set_join(docs.limit(0)).count() == 0


def test_dedup_bytes(docs):
    found = by_id(dedup_bytes(docs))
    size = len(PASSAGE)
    assert (found[1]["n_removed"], found[2]["n_removed"], found[2]["n_spans"]) == (0, size, 1)
    assert bytes(found[2]["kept"]) == b""
    assert (found[3]["n_bytes"], found[4]["n_bytes"], found[None]["n_removed"]) == (0, 0, 0)
    # The long text repeats itself, so all but its first period goes.
    text = LONG.encode()
    period = text.index(b"long0 ", 1)
    assert found[8]["n_removed"] == len(text) - period
    assert dedup_bytes(docs.limit(0)).count() == 0


def test_dedup_substrings(docs):
    found = by_id(dedup_substrings(docs, cells=1 << 18))
    assert (found[1]["n_removed"], found[2]["n_removed"], found[2]["kept_text"]) == (0, 80, "")
    # Only smaller documents count, so a text that repeats itself stays.
    assert (found[8]["n_words"], found[8]["n_removed"]) == (120_000, 0)
    assert (found[3]["n_words"], found[3]["kept_text"], found[None]["n_removed"]) == (0, "", 0)
    assert dedup_substrings(docs.limit(0), cells=1 << 18).count() == 0


def test_decontamination(spark, docs):
    items = [(1, PASSAGE.upper()), (2, None), (3, ""), (4, "one TWO"), (None, "one two"), (5, "no such words at all")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (2, 1), (6, 4), (7, 4)}
    assert found[1, 1]["similarity"] == 1.0 and found[1, 1]["start"] == 0
    clean = {r["doc_id"] for r in decontaminate(docs, benchmark).select("doc_id").collect()}
    assert clean == {3, 4, 5, 8, 9, None}
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0


def test_near_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, [0.0, 0.0], 1), (7, None, 1), (8, [], 1), (9, [1.0, None], 1), (10, [inf, 1.0], 1), (11, [nan, 1.0], 1),
        (12, [1.0, 0.0, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [-1.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("key", F.lit("x"))
    found = {r["vec_id"]: r for r in near_vectors(vectors).collect()}
    assert {i: r["n_links"] for i, r in found.items() if r["n_links"]} == {1: 3, 2: 3, 3: 3, 13: 3}
    assert {r["component_id"] for i, r in found.items() if i in (1, 2, 3, 13)} == {1}
    assert sorted(i for i, r in found.items() if not r["kept"]) == [2, 3, 13]
    assert near_vectors(vectors.limit(0)).count() == 0


def test_counts(docs):
    found = by_id(with_bpe_count(docs))
    assert (found[3]["tokens"], found[4]["tokens"]) == (0, 0)
    assert found[6]["tokens"] == 2
    words = by_id(with_word_count(docs))
    assert (words[3]["tokens"], words[1]["tokens"], words[5]["tokens"]) == (0, 80, 0)
