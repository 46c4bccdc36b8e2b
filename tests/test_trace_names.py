"""Names of a trace table are joined to ids that are written once, but where a key is hot."""

import cladeframe as cf
import pytest
from cladeframe.operators import joins
from conftest import TREE, rows


@pytest.fixture
def nodes():
    out = [(1, "root", 1, "no rank"), (2, "sk", 1, "superkingdom"), (3, "fam", 2, "family")]
    for g in range(40):
        out.append((100 + g, f"genus {g}", 3 if g % 7 else 888, "genus"))
        out += [(1000 + 10 * g + i, f"species {g} {i}", 100 + g, "species" if i else "no rank") for i in range(5)]
    return out


def test_only_hot_names_are_written_again(spark, nodes, forced_shuffle, monkeypatch):
    tree = spark.createDataFrame(nodes, TREE)
    calls, plain = [], joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, *more, **named: calls.append(1) or plain(df, *more, **named))
    found = rows(cf.trace_table(tree.select("taxid"), tree, cf.DIRECT), "taxid", "species_name", "genus_name", "family_name")
    # Top, superkingdom and family have one answer for most nodes; species and genera have few rows each.
    assert len(calls) == 3
    want = []
    above = {t: (name, parent, rank) for t, name, parent, rank in nodes}
    for t in above:
        names, at = {}, t
        while at in above:
            name, parent, rank = above[at]
            names.setdefault(rank, name)
            if at == parent:
                break
            at = parent
        end = "root" if at == 1 else "unknown"
        want.append((t, *[names.get(r, end) for r in ("species", "genus", "family")]))
    assert found == sorted(want, key=repr)
