"""Snapshots change no result, and neither totals nor commits read what they cover."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.llm.token_counts import CHANGES, TokenRollup
from cladeframe.operators.staging import fresh_path

SCHEMA = "seq int, op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"


def _batches():
    rng = random.Random(11)
    for _ in range(7):
        yield [
            (
                seq, rng.choice(["insert", "revise", "delete"]), rng.randrange(12), rng.choice(["a", "b", None]),
                rng.choice(["en", None]), rng.choice(["t", "u"]), rng.randrange(50),
            )
            for seq in range(rng.choice([0, 1, 9]))
        ]


def _plain(batches):
    """Totals by a dictionary of documents."""
    state, seen = {}, set()
    for rows in batches:
        for _, op, doc, source, lang, tokenizer, tokens in rows:
            last = max(r for r in rows if (r[2], r[5]) == (doc, tokenizer))
            if last[1] != op or last[0] != _:
                continue
            if op == "delete":
                state.pop((doc, tokenizer), None)
            else:
                state[doc, tokenizer] = (source, lang, tokens)
                seen.add((source, lang, tokenizer))
    out = {key: (0, 0) for key in seen}
    for (_, tokenizer), (source, lang, tokens) in state.items():
        t, n = out[source, lang, tokenizer]
        out[source, lang, tokenizer] = (t + tokens, n + 1)
    return out


@pytest.mark.parametrize("every", [1, 2, 3, 16])
def test_snapshots_change_nothing(spark, every):
    rollup = TokenRollup(spark, fresh_path(spark), every)
    batches = list(_batches())
    for i, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, SCHEMA).select(*CHANGES)
        assert rollup.commit(i, changes)
        assert not rollup.commit(i, changes)
        # All that is read is the last snapshot and fewer than `every` batches.
        assert sum(n.startswith("batch-") for n in rollup._sources()) < every
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert found == _plain(batches)
    assert TokenRollup(spark, rollup.path, 99).totals().exceptAll(rollup.totals()).isEmpty()


def test_unfinished_snapshot_is_not_read(spark):
    rollup = TokenRollup(spark, fresh_path(spark))
    rows = [(0, "insert", 1, "a", "en", "t", 5), (0, "insert", 2, "a", "en", "t", 6)]
    assert not rollup.compact()
    rollup.commit(0, spark.createDataFrame(rows, SCHEMA))
    # A snapshot whose job died: rows, but no mark of success.
    lost = f"{rollup.path}/snapshot-{0:012d}"
    spark.createDataFrame([], "doc_id bigint, kind string").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(lost)
    assert rollup._sources() == ["batch-000000000000"]
    assert rollup.totals().first()["tokens"] == 11
    assert rollup.compact()
    assert not rollup.compact()
    assert rollup._sources() == ["snapshot-000000000000"]
    assert tuple(rollup.totals().first()) == ("a", "en", "t", 11, 2)
    assert {tuple(r) for r in rollup.state().select("doc_id", "tokens").collect()} == {(1, 5), (2, 6)}


def test_totals_read_no_documents(spark):
    rollup = TokenRollup(spark, fresh_path(spark))
    rollup.commit(0, spark.createDataFrame([(0, "insert", 1, "a", "en", "t", 5)], SCHEMA))
    files = rollup._rows("amount").select(F.input_file_name()).distinct().collect()
    assert files and all("kind=amount" in r[0] for r in files)
    plan = rollup.totals()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
