"""Lineage operators against a plain walk, on trees with every kind of defect."""

import random

import pytest
from conftest import MAP, TREE, rows
from plain_walk import Walker

import cladeframe as cf
from cladeframe.schemas import RANKS


def broken_tree():
    tree = [
        (1, "root", 1, "no rank"),
        (2, "Bacteria", 131567, "superkingdom"),
        (131567, "cellular organisms", 1, "no rank"),
        (10, 'ssRNA viruses, no "DNA" stage', 2, "family"),
        (11, "O'Brien's genus", 10, "Genus"),
        (12, "sp one", 11, "SPECIES"),
        (13, "strain", 12, "no rank"),
        (14, "deeper strain", 13, "subspecies"),
        (15, "sp without genus", 10, "species"),
        (16, "skips species", 11, "varietas"),
        # Duplicates: an exact copy, and two rows that disagree.
        (12, "sp one", 11, "SPECIES"),
        (17, "late copy", 15, "species"),
        (17, "early copy", 11, "species"),
        # A top of its own, once with a rank; a missing parent; parent -1.
        (999999, "self loop", 999999, "no rank"),
        (20, "below self loop", 999999, "species"),
        (21, "ranked top", 21, "superkingdom"),
        (22, "below ranked top", 21, "genus"),
        (30, "orphan", 777, "genus"),
        (31, "below orphan", 30, "species"),
        (32, "no parent at all", -1, "family"),
        # Two nodes in a circle with one below; a circle longer than the forest is deep.
        (40, "circle a", 41, "species"),
        (41, "circle b", 40, "genus"),
        (42, "below circle", 40, "no rank"),
    ]
    ring = list(range(100, 123))
    tree += [(x, f"ring {x}", ring[(i + 1) % len(ring)], "no rank") for i, x in enumerate(ring)]
    tree = [(t, n, p, "family" if t == 118 else r) for t, n, p, r in tree]
    tree += [(130, "into ring", 100, "species"), (131, "into ring too", 130, "no rank")]
    return tree


def random_tree(seed, size=400):
    """Tree in which one node owns a third of all others and chains can be long."""
    rng = random.Random(seed)
    ranks = ["species", "genus", "family", "superkingdom", "no rank", "order"]
    tree = [(1, "root", 1, "no rank")]
    for x in range(2, size):
        pick = rng.random()
        parent = 5 if pick < 0.33 and x > 5 else x - 1 if pick < 0.7 else rng.randrange(1, x)
        parent = 10_000_000 + x if rng.random() < 0.02 else parent
        tree.append((x, f"n{x}", parent, rng.choice(ranks)))
    return tree


TREES = {"broken": broken_tree(), "random": random_tree(7)}


@pytest.fixture(scope="module", params=sorted(TREES))
def case(request, spark):
    tree = TREES[request.param]
    taxonomy = cf.Taxonomy(spark.createDataFrame(tree, TREE))
    ids = sorted({t[0] for t in tree} | {t[2] for t in tree} | {-1, 555})
    keys = spark.createDataFrame([(i,) for i in ids], "taxid bigint")
    return taxonomy, Walker(tree), ids, keys


def check_all(spark, taxonomy, walker, ids, keys):
    ranks = [*RANKS, "no rank"]
    expected = [(i, r, *walker.ancestor(i, r)) for i in ids for r in ranks]
    assert rows(cf.ancestor_at_rank(keys, taxonomy, ranks)) == sorted(expected, key=repr)

    expected = [(i, r, walker.label(i, r)) for i in ids for r in ranks]
    assert rows(cf.rank_name(keys, taxonomy, ranks)) == sorted(expected, key=repr)

    expected = [(i, *step) for i in ids for step in walker.steps(i)]
    assert rows(cf.lineage(keys, taxonomy)) == sorted(expected, key=repr)

    expected = [
        (i, [s[1] for s in reversed(walker.steps(i))], walker.steps(i)[0][4]) for i in ids
    ]
    assert rows(cf.paths(keys, taxonomy)) == sorted(expected, key=repr)

    pairs = [(a, x) for x in walker.node for a in walker.above(x) if a in ids]
    assert rows(cf.descendants(keys, taxonomy)) == sorted(pairs, key=repr)

    sons = [(n[1], x) for x, n in walker.node.items() if n[1] in ids]
    assert rows(cf.children(keys, taxonomy)) == sorted(sons, key=repr)

    first = []
    for i in ids:
        first += sorted((p, x) for p, x in sons if p == i)[:3]
    assert rows(cf.children(keys, taxonomy, 3)) == sorted(first, key=repr)

    mapped = [(f"A{x}", f"AA{x % 50}.1", x, 0) for x in [*walker.node, 555] for _ in range(2)]
    acc_map = spark.createDataFrame(mapped, MAP)
    expected = {(a, f"AA{x % 50}.1") for a, x in pairs} | {
        (x, f"AA{x % 50}.1") for x in [*walker.node, 555] if x in ids
    }
    found = cf.descendant_accessions(keys, taxonomy, acc_map)
    assert rows(found) == sorted(expected, key=repr)


def test_against_walk(spark, case):
    check_all(spark, *case)


def test_against_walk_shuffled(spark, forced_shuffle):
    """The same on the way taken by tables too large to broadcast."""
    tree = TREES["random"]
    taxonomy = cf.Taxonomy(spark.createDataFrame(tree, TREE))
    ids = sorted({t[0] for t in tree} | {t[2] for t in tree} | {-1})
    keys = spark.createDataFrame([(i,) for i in ids], "taxid bigint")
    check_all(spark, taxonomy, Walker(tree), ids, keys)


def test_deep_chain(spark):
    """Depth is not limited."""
    size = 700
    tree = [(i, f"n{i}", max(i - 1, 1), "species" if i == 2 else "no rank") for i in range(1, size)]
    keys = spark.createDataFrame([(size - 1,)], "taxid bigint")
    found = cf.ancestor_at_rank(keys, spark.createDataFrame(tree, TREE), "species")
    assert rows(found, "ancestor", "status") == [(2, "found")]
    assert cf.paths(keys, cf.Taxonomy(spark.createDataFrame(tree, TREE))).first()["path"] == list(
        range(1, size)
    )


def test_ancestor_is_idempotent(spark, case):
    taxonomy, _, _, keys = case
    for rank in RANKS:
        once = cf.ancestor_at_rank(keys, taxonomy, rank).where("status = 'found'")
        again = cf.ancestor_at_rank(once.selectExpr("ancestor AS taxid"), taxonomy, rank)
        assert again.where("taxid <> ancestor").count() == 0


def test_parent_hops(spark, case):
    taxonomy, walker, _, _ = case
    expected = []
    for x in walker.node:
        chain = [x]
        while len(chain) < 4 and walker.node[chain[-1]][1] in walker.node:
            chain.append(walker.node[chain[-1]][1])
        if len(chain) == 4:
            expected.append(tuple(chain))
    found = cf.parent_hops(taxonomy, 3)
    assert rows(found, *[f"taxid_t{i}" for i in range(4)]) == sorted(expected, key=repr)
    assert rows(found.selectExpr("parent_t0 - taxid_t1 AS d").distinct()) == [(0,)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 13])
def test_nth_parent(spark, case, n):
    taxonomy, walker, ids, keys = case
    expected = []
    for x in ids:
        at = x if x in walker.node else None
        for _ in range(n):
            at = walker.node[at][1] if at in walker.node else None
        expected.append((x, at if at in walker.node else None))
    assert rows(cf.nth_parent(keys, taxonomy, n)) == sorted(expected, key=repr)


def test_intervals_nest(spark, case):
    """Numbers are unique, and a node's range holds exactly what is below it."""
    taxonomy, walker, _, _ = case
    place = {r["taxid"]: (r["entry"], r["size"]) for r in taxonomy.intervals().collect()}
    assert len({entry for entry, _ in place.values()}) == len(place)
    below = {}
    for x in walker.node:
        if walker.chain(x)[1] != "cycle":
            for a in walker.above(x):
                below.setdefault(a, set()).add(x)
    for x, (entry, size) in place.items():
        assert {y for y, (e, _) in place.items() if entry < e < entry + size} == below.get(x, set())


def test_a_climb_writes_no_row_twice(spark, monkeypatch):
    """Rounds carry open rows of bounded width; what they finish is not written again."""
    from cladeframe.operators import climb as module

    size = 3000
    tree = [(i, f"n{i}", max(i - 1, 1), RANKS[i % 4]) for i in range(1, size)]
    taxonomy = cf.Taxonomy(spark.createDataFrame(tree, TREE))
    written = []

    def spy(df, *args, **kwargs):
        staged = cf.stage(df, *args, **kwargs)
        written.append(module.counted(staged))
        return staged

    monkeypatch.setattr(module, "stage", spy)
    monkeypatch.setattr(module, "within_broadcast", lambda df: False)
    answers = taxonomy.answers(RANKS, cf.CASCADE)
    assert answers.count() == size - 1
    opened = [w.parts["open"].rows for w in written if "open" in w.parts]
    finished = [w.parts["done"].rows for w in written if "open" in w.parts]
    assert opened == sorted(opened, reverse=True) and opened[-1] == 0
    assert sum(finished) == size - 3
    # The same width whatever the stretch has met.
    assert max(w.widest_row for w in written) <= 48 + 8 * (5 + 11) + 16


@pytest.mark.parametrize("mode", [cf.CASCADE, cf.DIRECT])
def test_trace_table(spark, case, mode):
    taxonomy, walker, ids, keys = case
    expected = []
    for x, (name, parent, rank) in walker.node.items():
        row, at = [x, name, parent, rank], x
        for r in RANKS:
            answer = walker.ancestor(at, r)[0]
            row += [answer, walker.node[answer][0] if answer in walker.node else "unknown"]
            at = answer if mode == cf.CASCADE else x
        expected.append(tuple(row))
    assert rows(cf.trace_table(keys, taxonomy, mode)) == sorted(expected, key=repr)


def test_empty_tree(spark):
    tree = spark.createDataFrame([], TREE)
    keys = spark.createDataFrame([(3,)], "taxid bigint")
    found = cf.ancestor_at_rank(keys, tree, "genus")
    assert rows(found) == [(3, "genus", -1, "unresolved")]
    assert rows(cf.lineage(keys, tree), "depth", "step_taxid") == [(0, 3), (1, -1)]
