"""Joins and running sums under skew, compared with the plain way."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe.operators import joins
from cladeframe.operators.report import _level_totals
from cladeframe.operators.staging import derived, stage, within_broadcast


def skewed(spark, n=3000):
    rng = random.Random(3)
    data = [(7 if rng.random() < 0.4 else rng.choice([None, *range(200)]), i) for i in range(n)]
    return spark.createDataFrame(data, "k bigint, v bigint")


def test_hot_keys_finds_the_heavy_one(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    assert joins.hot_keys(skewed(spark), "k") == [7]
    monkeypatch.setattr(joins, "HOT_ROWS", 10_000)
    assert joins.hot_keys(skewed(spark), "k") == []
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    assert joins.hot_keys(skewed(spark).where("false"), "k") == []


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [[], [7], [7, 8, 500]])
def test_split_join_equals_plain_join(spark, how, hot):
    facts = skewed(spark)
    dim = spark.range(0, 150, 3).selectExpr("id AS id2", "id * 10 AS w")
    dim = dim.union(spark.createDataFrame([(7, 70)], "id2 bigint, w bigint"))
    plain = facts.join(dim, F.col("k") == F.col("id2"), how)
    assert rows(joins.split_join(facts, dim, "k", "id2", how, hot)) == rows(plain)


def test_lookup_without_broadcast(spark, forced_shuffle):
    facts = skewed(spark)
    dim = spark.range(150).selectExpr("id AS id2", "id * 10 AS w")
    found = joins.lookup(facts, dim, "k", "id2")
    assert rows(found) == rows(facts.join(dim, F.col("k") == F.col("id2"), "left"))


def test_string_keys(spark, forced_shuffle):
    facts = skewed(spark).selectExpr("concat('s', k) AS k", "v")
    dim = spark.range(150).selectExpr("concat('s', id) AS id2", "id * 10 AS w")
    found = joins.lookup(facts, dim, "k", "id2", "inner")
    assert rows(found) == rows(facts.join(dim, F.col("k") == F.col("id2")))


def test_two_hundred_hot_keys(spark, forced_shuffle, monkeypatch):
    """Many keys above the bar are all found, and joined right with and without broadcast."""
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_PARTS", 50)
    facts = spark.range(6000).selectExpr("id % 200 AS k", "id AS v")
    hot = joins.hot_keys(facts.unionByName(spark.range(5000, 5400).selectExpr("id AS k", "id AS v")), "k")
    assert sorted(hot) == list(range(200))
    dim = stage(spark.range(300).selectExpr("id AS id2", "id * 10 AS w"))
    plain = rows(facts.join(dim, F.col("k") == F.col("id2"), "left"))
    assert rows(joins.split_join(facts, dim, "k", "id2", "left", hot)) == plain
    monkeypatch.setattr(joins, "threshold", lambda spark: 10**9)
    assert rows(joins.split_join(facts, dim, "k", "id2", "left", hot)) == plain


def test_only_counted_tables_are_small(spark):
    """Neither an estimate nor the size on disk proves that a table may be broadcast."""
    made = spark.range(1000).select(F.explode(F.sequence(F.lit(1), F.lit(2_000_000))).alias("id2"))
    assert not within_broadcast(made)
    assert not within_broadcast(made.distinct())
    assert not within_broadcast(spark.range(3))
    flat = stage(spark.range(1_000_000).selectExpr("id AS id2", "repeat('x', 100) AS w"))
    assert not within_broadcast(flat)
    assert not within_broadcast(derived(flat.select("id2"), flat))
    paths = stage(spark.range(200_000).selectExpr("id AS id2", "sequence(id, id + 30) AS path"))
    assert not within_broadcast(paths)
    facts = stage(spark.range(2000).selectExpr("id AS k"))
    plan = joins.lookup(facts, flat, "k", "id2", staged=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    few = stage(spark.range(100).selectExpr("id AS id2"))
    assert within_broadcast(few)
    assert within_broadcast(derived(few.selectExpr("id2 AS other"), few))


@pytest.mark.parametrize("k", [1, 2, 50])
def test_first_k(spark, k):
    data = skewed(spark)
    rank = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    plain = data.withColumn("n", rank).where(F.col("n") <= k).select("k", "v")
    assert rows(joins.first_k(data, "k", "v", k)) == rows(plain)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_totals(spark, coalesce):
    rng = random.Random(5)
    data = [(0 if rng.random() < 0.8 else rng.randrange(1, 4), rng.randrange(5), i) for i in range(900)]
    df = spark.createDataFrame(data, "_level int, v bigint, id bigint")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        found = _level_totals(df, [F.col("v").desc(), F.col("id")], "v")
        found = rows(found, "_level", "v", "id", "running", "line_no", "total")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    expected, so_far = [], {}
    for place, (g, v, i) in enumerate(sorted(data, key=lambda r: (r[0], -r[1], r[2])), 1):
        so_far[g] = so_far.get(g, 0) + v
        expected.append((g, v, i, so_far[g], place))
    expected = [(*row, so_far[row[0]]) for row in expected]
    assert found == sorted(expected, key=repr)
