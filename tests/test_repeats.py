"""Keys that repeat, found in two passes, against plain counting."""

from collections import Counter

import cladeframe as cf
import pytest
from cladeframe.operators import repeats
from conftest import rows

PAIRS = "k string, o bigint, v string"


def _pairs(n=3000):
    """Single keys, keys of two rows, one key with a third of all rows, nulls and empty keys."""
    out = [(f"single {i}", i, "a") for i in range(n)]
    out += [(f"double {i}", i % 7, v) for i in range(n // 100) for v in ("b", "a")]
    out += [("hot", i % 50, str(i % 3)) for i in range(n // 2)]
    return out + [(None, 3, "x"), (None, None, "y"), ("", 1, "z"), ("", 1, "z")]


def _plain_first(data):
    best = {}
    for k, o, v in data:
        rank = (o is not None, o or 0, v)
        best[k] = min(best.get(k, rank), rank)
    return sorted(((k, o if there else None, v) for k, (there, o, v) in best.items()), key=repr)


@pytest.mark.parametrize("buffer", [1 << 22, 100])
def test_against_plain_counting(spark, monkeypatch, buffer):
    monkeypatch.setattr(repeats, "BUFFER", buffer)
    data = _pairs()
    df = spark.createDataFrame(data, PAIRS).repartition(5)
    counted = Counter(k for k, _, _ in data)
    assert rows(cf.repeated_keys(df, "k")) == sorted(((k, n) for k, n in counted.items() if n > 1), key=repr)
    assert rows(cf.first_rows(df, "k", "o")) == _plain_first(data)


def test_beyond_the_broadcast_limit(spark, forced_shuffle):
    data = _pairs(400)
    df = spark.createDataFrame(data, PAIRS)
    once, rest = cf.split_repeats(df, "k")
    assert once is None and rest.count() == len(data)
    counted = Counter(k for k, _, _ in data)
    assert rows(cf.repeated_keys(df, "k")) == sorted(((k, n) for k, n in counted.items() if n > 1), key=repr)
    assert rows(cf.first_rows(df, "k", "o")) == _plain_first(data)


def test_only_repeats_are_shuffled(spark):
    data = _pairs()
    df = cf.stage(spark.createDataFrame(data, PAIRS))
    once, rest = cf.split_repeats(df, "k")
    counted = Counter(k for k, _, _ in data)
    # 2^44 cells: no single key of so few shares one with another key
    assert rows(once) == sorted((row for row in data if counted[row[0]] == 1), key=repr)
    assert rest.count() == sum(n for n in counted.values() if n > 1)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_keys_that_share_a_cell(spark, monkeypatch):
    """Cells only choose what is looked at: with one cell for all, results stay the same."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(repeats, "_place", lambda key: F.lit(5).cast("long"))
    data = _pairs(200)
    df = spark.createDataFrame(data, PAIRS)
    counted = Counter(k for k, _, _ in data)
    assert rows(cf.repeated_keys(df, "k")) == sorted(((k, n) for k, n in counted.items() if n > 1), key=repr)
    assert rows(cf.first_rows(df, "k", "o")) == _plain_first(data)


def test_empty_table(spark):
    df = spark.createDataFrame([], PAIRS)
    assert rows(cf.repeated_keys(df, "k")) == [] and rows(cf.first_rows(df, "k", "o")) == []



def test_two_columns_only(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    assert rows(cf.first_rows(df, "k", "o")) == [("a", 1), ("b", 3)]
