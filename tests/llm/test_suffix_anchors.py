"""Of the anchors of texts only those that may repeat are shuffled, and all of those."""

import random

import pytest
from cladeframe.llm import suffixes
from cladeframe.operators import repeats
from cladeframe.operators.staging import stage


def _texts(n=60):
    dice = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    own = ["".join(dice.choices(letters, k=3000)) for _ in range(n)]
    return own, own[0][500:900]


def test_single_anchors_stay(spark, monkeypatch):
    own, passage = _texts()
    own[7] = own[7][:1000] + passage + own[7][1000:]
    dealt = []
    plain = suffixes.repeated

    def counting(anchors):
        dealt.append(anchors.count())
        return plain(anchors)

    monkeypatch.setattr(suffixes, "repeated", counting)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string").repartition(3)
    found = suffixes.repeated_windows(docs).collect()
    starts = {(r["doc_id"], s) for r in found for s in range(r["start"], r["start"] + r["n"])}
    assert {(7, s) for s in range(1000, 1301)} <= starts
    assert {d for d, _ in starts} == {7}
    # 180,000 bytes hold some 5,000 anchors, of which about a dozen stand twice.
    assert dealt[0] < 200


@pytest.mark.parametrize("most", [29, 18])
def test_all_that_repeats_passes(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "FILTER_MOST", most)
    n = 60_000
    keys = [(i * 7919, i) for i in range(n)] + [(i * 7919, -i - 1) for i in range(0, n, 3)] + [(None, 1), (None, 2)]
    df = stage(spark.createDataFrame(keys, "k bigint, v bigint").repartition(5))
    passed = repeats.may_repeat(df, "k").collect()
    left = {(r["k"], r["v"]) for r in passed}
    again = {k for k, v in keys if v < 0} | {None}
    assert len(passed) == len(left)
    assert {(k, v) for k, v in keys if k in again} <= left <= set(keys)
    if most > 18:
        assert len(left) < 1.05 * sum(k in again for k, _ in keys)


def test_nothing_repeats(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert repeats.may_repeat(df, "k").count() == 0
    assert repeats.may_repeat(df.where("k < 0"), "k").count() == 0
