"""Every registered query against its SQL text on the smallest test tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from cladeframe.plans import oracle, queries as library

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")

QUERIES, ORACLE = driver.queries(), oracle.ORACLE
# Queries that join on a key some rows share, checked on the large-table way too.
SKEWED = [
    "accver_by_taxid",
    "taxid_by_name",
    "node_by_name",
    "children_by_taxid",
    "rank_by_accver",
    "rank_name_by_accver",
    "lineage_trace",
    "descendants",
    "descendant_accessions",
    "parent_hops",
    "trace_table",
    "annotate_hits",
    "report",
]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, engine, name):
    df = QUERIES[name](spark, str(DATA))
    result = engine.execute(ORACLE[name])
    columns = sorted(c[0] for c in result.description)
    assert sorted(df.columns) == columns
    place = [next(i for i, c in enumerate(result.description) if c[0] == n) for n in columns]
    expected = Counter(tuple(r[i] for i in place) for r in result.fetchall())
    found = Counter(tuple(r) for r in df.select(*columns).collect())
    assert found == expected
    assert expected


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, engine, name):
    compare(spark, engine, name)


@pytest.mark.parametrize("name", SKEWED)
def test_query_shuffled(spark, engine, forced_shuffle, name):
    compare(spark, engine, name)


def test_registry(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert not {n for n in library.QUERIES if n not in ORACLE}
    assert driver.entry(spark).count() == 2523
