"""Accessions below a key come from a climb: no ranges and no pairs of nodes are written out."""

import cladeframe as cf
import pytest
from cladeframe.operators import lineage
from conftest import MAP, TREE, rows

# A forest: a root, a missing parent (700), a cycle (801, 802) with a node below it, an id that is its own parent.
NODES = [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 2), (71, 700), (72, 71), (801, 802), (802, 801), (803, 801), (9, 9)]
KEYS = [1, 3, 6, 700, 72, 801, 803, 9, 555, 777, None]
# Accessions with one taxid, twice the same, several, none, one that the tree does not know, and one nobody asks for.
MAPPED = [("A", 5), ("A", 5), ("B", 5), ("B", 6), ("B", 72), ("C", None), ("D", 555), ("E", 556), ("F", 803), ("G", 802), ("H", 1)]
MAPPED += [("I", 700), ("I", None), ("J", 9), ("K", 71)]


def expected():
    parent = dict(NODES)

    def chain(x):
        seen = []
        while x not in seen:
            seen.append(x)
            x = parent.get(x, x)
        return seen

    return sorted({(k, a) for a, x in MAPPED if x is not None for k in chain(x) if k in KEYS}, key=repr)


def found(spark):
    tree = spark.createDataFrame([(x, f"n{x}", p, "x") for x, p in NODES], TREE)
    acc_map = spark.createDataFrame([(a, a, x, 0) for a, x in MAPPED], MAP)
    keys = spark.createDataFrame([(k,) for k in KEYS for _ in range(2)], "taxid bigint")
    return rows(cf.descendant_accessions(keys, tree, acc_map), "taxid", "acc_ver")


@pytest.fixture
def no_ranges(monkeypatch):
    def refuse(*_):
        raise AssertionError("ranges of entry numbers are asked for")

    monkeypatch.setattr(lineage, "number", refuse)
    monkeypatch.setattr(lineage, "spread", refuse)


def test_without_ranges(spark, no_ranges):
    assert found(spark) == expected()


def test_without_ranges_shuffled(spark, no_ranges, forced_shuffle):
    assert found(spark) == expected()
