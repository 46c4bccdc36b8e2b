"""Rollup and report against a dictionary version of the same procedure.

Fixed values: the layouts, column widths and headings of printed lines.
"""

import random

import pytest
from conftest import MAP, TREE, rows
from plain_walk import Walker
from test_lineage import TREES

import cladeframe as cf
from cladeframe.schemas import LEVELS, RANKS


def plain_rollup(freq, walker):
    """Level by level: {level: {taxid: [parent, name, tally, children]}}."""
    table = {LEVELS[0]: {}}
    for acc, (n, taxid) in freq.items():
        up = walker.ancestor(taxid, RANKS[0])[0]
        name = walker.node.get(taxid, ("unknown",))[0]
        entry = table[LEVELS[0]].setdefault(taxid, [up, name, 0, []])
        entry[2] += n
        entry[3].append(acc)
    for below, level, above in zip(LEVELS, RANKS, (*RANKS[1:], None)):
        table[level] = {}
        for child, (taxid, _, tally, _) in table[below].items():
            up = walker.ancestor(taxid, above)[0] if above else None
            entry = table[level].setdefault(taxid, [up, walker.label(taxid, level), 0, []])
            entry[2] += tally
            entry[3].append(child)
    return table


@pytest.fixture(scope="module", params=sorted(TREES))
def case(request, spark):
    rng = random.Random(2)
    walker = Walker(TREES[request.param])
    # A third of the accessions sit on one taxid, some on taxids outside the tree.
    targets = [*walker.node, 888, -1]
    freq = {}
    for i in range(600):
        freq[f"AB_{i}.1"] = (rng.randrange(1, 9), rng.choice(targets) if i % 3 else targets[-3])
    resolved = spark.createDataFrame(
        [(a, n, t) for a, (n, t) in freq.items()], "acc_ver string, freq bigint, taxid bigint"
    )
    taxonomy = cf.Taxonomy(spark.createDataFrame(TREES[request.param], TREE))
    return plain_rollup(freq, walker), walker, resolved, taxonomy


def check_rollup(table, walker, resolved, taxonomy):
    expected = [
        (
            level,
            taxid,
            up,
            name,
            walker.node.get(taxid, (0, 0, "no rank"))[2] if level == LEVELS[0] else None,
            tally,
            len(kids),
        )
        for level, nodes in table.items()
        for taxid, (up, name, tally, kids) in nodes.items()
    ]
    assert rows(cf.rank_rollup(resolved, taxonomy)) == sorted(expected, key=repr)
    expected = [
        (level, taxid, str(kid))
        for level, nodes in table.items()
        for taxid, entry in nodes.items()
        for kid in entry[3]
    ]
    assert rows(cf.rollup_children(resolved, taxonomy)) == sorted(expected, key=repr)


def test_rollup(case):
    check_rollup(*case)


def test_rollup_shuffled(case, forced_shuffle):
    check_rollup(*case)


def test_report(case):
    table, walker, resolved, taxonomy = case
    reported = cf.report(cf.rank_rollup(resolved, taxonomy))
    ordered, lines, place = [], [], 0
    for level in LEVELS:
        nodes, so_far = table[level], 0
        total = sum(entry[2] for entry in nodes.values())
        if level == LEVELS[0]:
            lines.append("           =================== Taxid at Accession.V ==================")
        else:
            lines.append(f"           =================== Rank Level: {level}  ==================")
        lines.append(
            "   count  percentage  Rank name                                                  "
            "       [  taxid  ] (running tally)"
        )
        for taxid in sorted(nodes, key=lambda t: (-nodes[t][2], nodes[t][1], t)):
            _, name, tally, _ = nodes[taxid]
            so_far, place = so_far + tally, place + 1
            share = tally / total * 100
            ordered.append((place, level, taxid, tally, share, so_far))
            if level == LEVELS[0]:
                name = f"{name} ({walker.node.get(taxid, (0, 0, 'no rank'))[2]})"
            lines.append(
                "%8d  %8.4f %%    %s    [ %s ] ( %11d )"
                % (tally, share, f"{name: <60}", f"{taxid: >7}", so_far)
            )
        lines.append("")
    columns = ("line_no", "rank_level", "taxid", "tally", "percentage", "running_tally")
    found = sorted(tuple(r) for r in reported.select(*columns).collect())
    assert found == ordered
    text = sorted(tuple(r) for r in cf.report_lines(reported).collect())
    assert [n for n, _ in text] == list(range(1, len(lines) + 1))
    assert [line for _, line in text] == lines
    html = cf.report_html_rows(reported).where("line_no = 1").first()["html"]
    assert html.startswith("<TR><TD>") and f"id={ordered[0][2]}'>\t" in html


def test_invariants(case):
    _, _, resolved, taxonomy = case
    hits = resolved.agg({"freq": "sum"}).first()[0]
    rollup = cf.rank_rollup(resolved, taxonomy)
    reported = cf.report(rollup)
    sums = reported.groupBy("rank_level").agg({"tally": "sum", "percentage": "sum", "running_tally": "max"})
    for row in sums.collect():
        assert row["sum(tally)"] == row["max(running_tally)"] == hits
        assert abs(row["sum(percentage)"] - 100) < 1e-6


def test_empty_report(spark):
    resolved = spark.createDataFrame([], "acc_ver string, freq bigint, taxid bigint")
    reported = cf.report(cf.rank_rollup(resolved, spark.createDataFrame([], TREE)))
    assert reported.count() == 0
    assert sorted(r[0] for r in cf.report_lines(reported).collect()) == list(range(1, 16))


def test_duplicate_map_rows_change_nothing(spark):
    keys = spark.createDataFrame([("AB_1.1", 5), ("AB_2.1", 3), ("AB_3.1", 2)], "acc_ver string, freq bigint")
    mapped = [("AB_1", "AB_1.1", 9, 0), ("AB_1", "AB_1.1", 4, 0), ("AB_2", "AB_2.1", 7, 0)] * 3
    found = cf.resolve_accessions(keys, spark.createDataFrame(mapped, MAP))
    assert rows(found) == [("AB_1.1", 5, 4), ("AB_2.1", 3, 7), ("AB_3.1", 2, -1)]


def test_summary(spark):
    counters = spark.createDataFrame(
        [(12, 1234567, 8)], "unique_accessions bigint, accepted_rows bigint, rejected_rows bigint"
    )
    found = rows(cf.report_summary(counters, "job", "first 100% of it"))
    assert found == [
        (1, "<TR><TD>Job Name:             </TD><TD>job</TD></TR>"),
        (2, "<TR><TD>Job Desc:             </TD><TD>first 100% of it</TD></TR>"),
        (3, "<TR><TD>Unique Acc.V Count:   </TD><TD>12</TD></TR>"),
        (4, "<TR><TD>Total rows processed: </TD><TD>1,234,567</TD></TR>"),
        (5, "<TR><TD>Rejected rows:        </TD><TD>8</TD></TR>"),
    ]


def test_names_of_a_rollup_are_joined_without_copies_of_levels(spark, forced_shuffle, monkeypatch):
    """Levels have one row per id: no level is written again, nor searched for hot keys, to be named."""
    from cladeframe.operators import joins, rollup

    tree = [(1, "root", 1, "no rank"), (2, "f", 1, "family"), (3, "g", 2, "genus"), (4, "lone", 4, "genus"), (9, "lost", 77, "species")]
    tree += [(i, f"s{i}", 3 if i % 2 else 4, "species") for i in range(100, 160)]
    taxonomy = cf.Taxonomy(spark.createDataFrame(tree, TREE))
    taxonomy.answers(RANKS, "cascade")
    taxonomy.names(RANKS)
    taxids = [*range(100, 160), 9, 4, 1, -1, 888]
    resolved = spark.createDataFrame([(f"A{t}", 2, t) for t in taxids], "acc_ver string, freq bigint, taxid bigint")

    def refused(*args, **kwargs):
        raise AssertionError("a level was copied")

    monkeypatch.setattr(joins, "stage", refused)
    monkeypatch.setattr(joins, "hot_keys", refused)
    walker = Walker(tree)
    table = plain_rollup({f"A{t}": (2, t) for t in taxids}, walker)
    check_rollup(table, walker, resolved, taxonomy)
