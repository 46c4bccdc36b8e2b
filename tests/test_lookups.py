"""Key lookups, with and without broadcast."""

import pytest
from conftest import MAP, TREE, rows

import cladeframe as cf

TREE_ROWS = [(1, "root", 1, "no rank"), (2, "Bacteria", 1, "superkingdom")]
TREE_ROWS += [(i, "environmental samples", 2, "species") for i in range(100, 160)]
TREE_ROWS += [(629395, "Bacteria", 100, "genus"), (7, "it's, \"quoted\"", 629395, "species")]
MAP_ROWS = [(f"AB_{i}", f"AB_{i}.1", 100 if i % 3 == 0 else i, i) for i in range(90, 190)]
MAP_ROWS += [("AB_90", "AB_90.1", 100, 90)] * 5


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def check(spark):
    tree = cf.Taxonomy(spark.createDataFrame(TREE_ROWS, TREE))
    acc_map = spark.createDataFrame(MAP_ROWS, MAP)
    asked = names(spark, "Bacteria", "environmental samples", "nobody", "it's, \"quoted\"", "Bacteria")
    assert rows(cf.taxid_by_name(asked, tree, 2)) == sorted(
        [
            ("Bacteria", 2),
            ("Bacteria", 629395),
            ("environmental samples", 100),
            ("environmental samples", 101),
            ("nobody", -1),
            ("it's, \"quoted\"", 7),
        ],
        key=repr,
    )
    assert rows(cf.node_by_name(asked, tree)) == sorted(
        [
            ("Bacteria", 2, "superkingdom", 1),
            ("environmental samples", 100, "species", 2),
            ("nobody", -1, "no rank", -1),
            ("it's, \"quoted\"", 7, "species", 629395),
        ],
        key=repr,
    )
    assert rows(cf.children_by_name(asked, tree, 2)) == sorted(
        [
            ("Bacteria", 2, 100),
            ("Bacteria", 2, 101),
            ("environmental samples", 100, 629395),
        ],
        key=repr,
    )
    ids = spark.createDataFrame([(1,), (100,), (4242,), (-1,)], "taxid bigint")
    assert rows(cf.node_by_taxid(ids, tree)) == sorted(
        [
            (1, "root", 1, "no rank"),
            (100, "environmental samples", 2, "species"),
            (4242, "unknown", -1, "no rank"),
            (-1, "unknown", -1, "no rank"),
        ],
        key=repr,
    )
    mapped = {(t, a) for _, a, t, _ in MAP_ROWS if t in (1, 100, 4242)}
    assert rows(cf.accver_by_taxid(ids, acc_map)) == sorted(mapped, key=repr)
    keys = spark.createDataFrame([("AB_91.1",), ("AB_102.1",), ("XX_1.1",)], "acc_ver string")
    assert rows(cf.rank_by_accver(keys, acc_map, tree)) == sorted(
        [("AB_91.1", 91, "no rank"), ("AB_102.1", 100, "species"), ("XX_1.1", -1, "no rank")],
        key=repr,
    )


def test_lookups(spark):
    check(spark)


def test_lookups_shuffled(spark, forced_shuffle):
    check(spark)


def test_self_parent_is_its_own_child(spark):
    tree = spark.createDataFrame(TREE_ROWS, TREE)
    keys = spark.createDataFrame([(1,)], "taxid bigint")
    assert rows(cf.children(keys, tree)) == [(1, 1), (1, 2)]
    assert (1, 1) not in rows(cf.descendants(keys, tree))


def test_annotate_hits(spark):
    tree = cf.Taxonomy(spark.createDataFrame(TREE_ROWS, TREE))
    resolved = spark.createDataFrame(
        [("AB_1.1", 4, 7), ("AB_2.1", 2, -1)], "acc_ver string, freq bigint, taxid bigint"
    )
    trace = cf.trace_table(resolved, tree, cf.DIRECT)
    found = {r["acc_ver"]: r for r in cf.annotate_hits(resolved, trace).collect()}
    assert found["AB_1.1"]["genus_name"] == "Bacteria"
    assert found["AB_1.1"]["superkingdom_taxid"] == 2
    assert found["AB_2.1"]["name"] is None and found["AB_2.1"]["freq"] == 2


@pytest.mark.parametrize("limit", [0, -1])
def test_bad_limit(spark, limit):
    with pytest.raises(ValueError):
        cf.taxid_by_name(names(spark, "a"), spark.createDataFrame(TREE_ROWS, TREE), limit)
