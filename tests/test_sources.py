"""Files in and out."""

import gzip
import hashlib

import pytest
from conftest import MAP, TREE, rows

import cladeframe as cf
from cladeframe.schemas import ACCESSION_MAP

TREE_ROWS = [
    (1, "root", 1, "no rank"),
    (35278, "ssRNA positive-strand viruses, no DNA stage", 439488, "no rank"),
    (7, "O'Brien's \"quoted\" virus", 1, "species"),
    (8, "back\\slash", 1, "species"),
]
MAP_ROWS = [("A1", "A1.1", 5, 10), ("B2", "B2.3", 6, 11), ("B2", "B2.3", 6, 11)]


def test_tree_round_trips(spark, tmp_path):
    tree = spark.createDataFrame(TREE_ROWS, TREE)
    cf.write_tree_csv(tree, str(tmp_path / "csv"))
    assert rows(cf.read_tree(spark, str(tmp_path / "csv"))) == rows(tree)
    cf.write_tree(tree, str(tmp_path / "parquet"))
    assert rows(spark.read.parquet(str(tmp_path / "parquet"))) == rows(tree)


def test_tree_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"taxid","name","parent","rank"\n5,"five, and more",1,"genus"\n')
    (tmp_path / "b.csv").write_text('6,"say ""six""",5,species\n')
    found = cf.read_tree(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows(found) == [(5, "five, and more", 1, "genus"), (6, 'say "six"', 5, "species")]


def test_accession_files(spark, tmp_path):
    header = "accession\taccession.version\ttaxid\tgi\n"
    (tmp_path / "a").write_text(header + "A1\tA1.1 \t 5\t10\r\n" + 'Q"\tQ".1\t6\tNULL\n')
    with gzip.open(tmp_path / "b.gz", "wt") as out:
        out.write(header + "B2\tB2.3\t6\t11\n")
    found = cf.read_accession_map(spark, [str(tmp_path / "a"), str(tmp_path / "b.gz")])
    assert rows(found) == [("A1", "A1.1", 5, 10), ("B2", "B2.3", 6, 11), ('Q"', 'Q".1', 6, None)]
    assert found.schema.simpleString() == ACCESSION_MAP.simpleString()


def test_readers_lose_no_line(spark, tmp_path):
    text = "accession\taccession.version\ttaxid\tgi\n\tNC_1.1\t5\t10\naccession7\tNC_3.1\t7\t12\nX\tX.1\tfive\t1\n\nX\tX.1\n"
    (tmp_path / "map").write_text(text)
    kept = cf.read_accession_map(spark, str(tmp_path / "map"))
    gone = cf.accession_rejects(spark, str(tmp_path / "map"))
    assert rows(kept) == [("", "NC_1.1", 5, 10), ("accession7", "NC_3.1", 7, 12)]
    assert rows(gone) == [("", "wrong_columns"), ("X\tX.1", "wrong_columns"), ("X\tX.1\tfive\t1", "bad_taxid")]
    (tmp_path / "tree").write_text('taxid,name,parent,rank\n5,,1,""\n5x,broken id,1,species\n9,nine,1,species,extra\n7,a,b,c\n')
    assert rows(cf.read_tree(spark, str(tmp_path / "tree"))) == [(5, "", 1, "")]
    assert rows(cf.tree_rejects(spark, str(tmp_path / "tree"))) == [
        ("5x,broken id,1,species", "bad_taxid"),
        ("7,a,b,c", "bad_parent"),
        ("9,nine,1,species,extra", "wrong_columns"),
    ]


def test_accession_stores(spark, tmp_path):
    acc_map = spark.createDataFrame(MAP_ROWS, MAP)
    cf.write_accession_map(acc_map, str(tmp_path / "sorted"))
    assert rows(spark.read.parquet(str(tmp_path / "sorted"))) == rows(acc_map)
    cf.save_accession_table(acc_map, "accessions_by_bucket", 4)
    table = spark.table("accessions_by_bucket")
    # Rows that repeat are rows of the map.
    assert rows(table) == rows(acc_map)
    keys = spark.createDataFrame([("B2.3", 2), ("C.1", 1)], "acc_ver string, freq bigint")
    assert rows(cf.resolve_accessions(keys, table)) == [("B2.3", 2, 6), ("C.1", 1, -1)]
    # The bucketed map is aggregated without a shuffle.
    plan = table.groupBy("acc_ver").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_build_tree(spark, tmp_path):
    line = "{}\t|\t{}\t|\t\t|\t{}\t|\n"
    (tmp_path / "names").write_text(
        line.format(2, "Monera", "synonym")
        + line.format(2, "Bacteria", "scientific name")
        + line.format(2, "Eubacteria", "scientific name")
        + line.format(3, "no node", "scientific name")
        + line.format(4, "only a synonym", "synonym")
    )
    node = "{}\t|\t{}\t|\t{}\t|\t\t|\n"
    (tmp_path / "nodes").write_text(
        node.format(2, 99, "genus") + node.format(2, 1, "superkingdom") + node.format(4, 1, "x")
    )
    tree = cf.build_tree(
        cf.read_names(spark, str(tmp_path / "names")), cf.read_nodes(spark, str(tmp_path / "nodes"))
    )
    assert rows(tree) == [(2, "Bacteria", 1, "superkingdom"), (3, "no node", 0, "")]


def test_trace_round_trip(spark, tmp_path):
    tree = cf.Taxonomy(spark.createDataFrame(TREE_ROWS, TREE))
    trace = cf.trace_table(tree.nodes, tree)
    path = str(tmp_path / "trace")
    cf.write_trace(trace, path)
    cf.write_trace(trace, path)
    stored = cf.read_trace(spark, path)
    assert rows(stored) == rows(trace)
    assert rows(cf.trace_filter(stored, "species"), "taxid") == [(7,), (8,)]
    assert rows(cf.trace_filter(stored, "species", keep=False), "taxid") == [(1,), (35278,)]
    assert rows(cf.trace_of(stored, 7), "species_taxid") == [(7,)]
    assert rows(cf.trace_counts(stored)) == [(4, 2, 2)]
    cf.write_trace(trace, str(tmp_path / "species"), rank="species")
    assert cf.read_trace(spark, str(tmp_path / "species")).count() == 2
    cf.register(stored, "trace_view")
    found = spark.sql("SELECT COUNT(taxid) AS n FROM trace_view WHERE rank = 'no rank'")
    assert rows(found) == [(2,)]


def test_report_file(spark, tmp_path):
    lines = spark.range(1, 200).selectExpr("200 - id AS line_no", "concat('line ', 200 - id) AS line")
    cf.write_lines(lines, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text == [f"line {i}" for i in range(1, 200)]


def read_lines(path):
    return sum(len(p.read_text().splitlines()) for p in path.parent.glob(path.name))


def test_dumps_lose_no_line(spark, tmp_path):
    """Kept and refused lines add up to the lines read; field ends tell a broken line."""
    names = (
        "2\t|\tBacteria\t|\t\t|\tscientific name\t|\n"
        "3\t|\tno last end\t|\t\t|\tsynonym\n"
        "4\t|\ta\ttab\t|\t\t|\tscientific name\t|\n"
        "x5\t|\tbad id\t|\t\t|\tscientific name\t|\r\n"
        "6\t|\tshort\t|\n\n"
        "7|packed|together|\n"
        " 8 \t|\t\t|\t\t|\tscientific name\t|\n"
    )
    nodes = "2\t|\t1\t|\tgenus\t|\tmore\t|\n3\t|\t\t|\tgenus\t|\n\t|\t1\t|\tx\t|\n4\t|\t1\n5\t|\t1\t|\t\t|\n"
    (tmp_path / "names").write_text(names)
    (tmp_path / "nodes").write_text(nodes)
    kept, gone = cf.read_names(spark, str(tmp_path / "names")), cf.names_rejects(spark, str(tmp_path / "names"))
    assert rows(kept, "taxid", "name", "name_class") == [
        (2, "Bacteria", "scientific name"),
        (3, "no last end", "synonym"),
        (8, "", "scientific name"),
    ]
    assert sorted(r[1] for r in rows(gone)) == ["bad_taxid"] + ["wrong_columns"] * 4
    assert kept.count() + gone.count() == read_lines(tmp_path / "names")
    kept, gone = cf.read_nodes(spark, str(tmp_path / "nodes")), cf.nodes_rejects(spark, str(tmp_path / "nodes"))
    assert rows(kept, "taxid", "parent", "rank") == [(2, 1, "genus"), (5, 1, "")]
    assert sorted(r[1] for r in rows(gone)) == ["bad_parent", "bad_taxid", "wrong_columns"]
    assert kept.count() + gone.count() == read_lines(tmp_path / "nodes")


def test_hash_lines_have_one_header_rule(spark):
    lines = ["accession\taccession.version\ttaxid\tgi", "accession\tA.1\t5\t1", "a\tb", "a\tb\tc\td\te", ""]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(cf.hash_input(frame)) == [("a", "b", "c"), ("accession", "A.1", "5")]
    assert rows(cf.hash_rejects(frame)) == [("", "wrong_columns"), ("a\tb", "wrong_columns")]
    both = cf.settle(cf.scan_hash_lines(frame, headers=True))
    assert (both.n_kept, both.n_rejects, both.n_headers, both.n_lines) == (2, 2, 1, 5)


def test_settle_reads_once_and_keeps_both(spark, tmp_path):
    text = "accession\taccession.version\ttaxid\tgi\nA\tA.1\t5\t1\nA\tA.1\tfive\t1\nB\n"
    (tmp_path / "map").write_text(text)
    scanned = cf.scan_accession_map(spark, str(tmp_path / "map"), headers=True)
    both = cf.settle(scanned, str(tmp_path / "out"))
    # What is left of the file does not matter any more.
    (tmp_path / "map").write_text("")
    assert rows(both.kept) == [("A", "A.1", 5, 1)]
    assert rows(both.rejects) == [("A\tA.1\tfive\t1", "bad_taxid"), ("B", "wrong_columns")]
    assert (both.n_kept, both.n_rejects, both.n_headers) == (1, 2, 1)
    plan = both.rejects._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(verdict" in plan
    # Rows kept are stored without their line.
    assert "line" not in both.kept.columns
    (tmp_path / "empty").write_text("")
    none = cf.settle(cf.scan_tree(spark, str(tmp_path / "empty"), headers=True))
    assert none.n_lines == 0 and none.kept.count() == 0 and none.rejects.count() == 0


def scanned(df):
    """Metrics of a query's scans after it has run, as a query of its own."""
    df = df.select("*")
    df.collect()
    out = {}

    def add(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return add(plan.finalPhysicalPlan())
        if kind.endswith("QueryStageExec"):
            return add(plan.plan())
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
                add(leaf)
            for name in ("numFiles", "numPartitions", "numOutputRows"):
                if leaf.metrics().contains(name):
                    out[name] = out.get(name, 0) + leaf.metrics().apply(name).value()

    add(df._jdf.queryExecution().executedPlan())
    return out


def made_trace(spark, n=4000):
    ranks = "CASE id % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'genus' WHEN 2 THEN '' ELSE NULL END"
    return spark.range(n).selectExpr("id AS taxid", "concat('n', id) AS name", "1L AS parent", f"{ranks} AS rank")


def test_trace_store_prunes(spark, tmp_path):
    trace, path = made_trace(spark), str(tmp_path / "store")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    cf.write_trace_store(trace, path)
    stored = cf.read_trace(spark, path)
    assert rows(stored.drop("rank_folder")) == rows(trace)
    species = cf.trace_filter(stored, "species")
    assert rows(species) == rows(trace.where("rank = 'species'"))
    assert rows(cf.trace_filter(stored, "")) == rows(trace.where("rank = ''"))
    assert rows(cf.trace_filter(stored, "species", keep=False)) == rows(trace.where("rank <> 'species'"))
    assert scanned(species)["numPartitions"] == 1
    point = cf.trace_of(stored, 1237)
    assert rows(point) == rows(trace.where("taxid = 1237"))
    # Row groups without the taxid in their range are skipped: at most one a folder is read.
    assert scanned(point)["numOutputRows"] < 4000 / 2
    assert "PushedFilters: [IsNotNull(taxid), EqualTo(taxid,1237)]" in point._jdf.queryExecution().executedPlan().toString()
    # One rank written again replaces its own folder only.
    cf.write_trace_store(trace.where("rank = 'species' AND taxid < 100"), path)
    again = cf.read_trace(spark, path)
    assert cf.trace_filter(again, "species").count() == 25
    assert again.count() == 3000 + 25
    assert spark.conf.get("spark.sql.shuffle.partitions") == old


def test_annotation_does_not_shuffle_a_bucketed_trace(spark, forced_shuffle):
    cf.save_trace_table(made_trace(spark), "trace_in_buckets", 4)
    resolved = spark.createDataFrame([("A", 1, 8), ("B", 2, -1), ("C", 3, 4001), ("D", 4, 9)], "acc_ver string, freq long, taxid long")
    found = cf.annotate_hits(resolved, spark.table("trace_in_buckets"), stored=True)
    plain = cf.annotate_hits(resolved, made_trace(spark))
    assert rows(found) == rows(plain)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "trace_in_buckets" in line and "Scan" in line)
    depth = plan[at].index("Scan")
    above = []
    for line in reversed(plan[:at]):
        start = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if start < depth:
            above.append(line)
            depth = start
            if "SortMergeJoin" in line:
                break
    assert above and not any("Exchange" in line for line in above)


def test_a_subtree_is_a_slice_of_the_map(spark, tmp_path):
    """One key reads the folders with numbers of its subtree, and of those only."""
    tree = [(1, "root", 1, "no rank")]
    tree += [(x, f"n{x}", x // 4 if x >= 8 else 1, "x") for x in range(2, 600)]
    tree += [(9000, "orphan", 7777, "x"), (9001, "a", 9002, "x"), (9002, "b", 9001, "x")]
    mapped = [(f"A{x}", f"A{x}.{v}", x, x) for x in [*range(1, 600), 9000, 9001, 555555] for v in (1, 1, 2)]
    taxonomy = cf.Taxonomy(spark.createDataFrame(tree, TREE))
    cf.cluster_accessions(spark.createDataFrame(mapped, MAP), taxonomy, str(tmp_path / "map"), slices=64)
    keys = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 40, 599, 9000, 7777, 555555, 9001)], "taxid long")
    expected = rows(cf.descendant_accessions(keys.where("taxid <> 9001"), taxonomy, spark.createDataFrame(mapped, MAP)))
    found = []
    for (key,) in keys.where("taxid <> 9001").collect():
        found += rows(cf.accessions_below(spark, str(tmp_path / "map"), key))
    assert sorted(found, key=repr) == expected
    assert rows(cf.accessions_below(spark, str(tmp_path / "map"), 9001), "acc_ver") == [("A9001.1",), ("A9001.2",)]
    whole = scanned(cf.accessions_below(spark, str(tmp_path / "map"), 1))
    leaf = scanned(cf.accessions_below(spark, str(tmp_path / "map"), 599))
    family = scanned(cf.accessions_below(spark, str(tmp_path / "map"), 40))
    assert whole["numFiles"] > 50
    assert leaf["numFiles"] <= 2
    assert family["numFiles"] <= 4


def test_key_hash(spark, tmp_path):
    lines = ["accession\taccession.version\ttaxid\tgi", "A1\tA1.1\t5\t10", "B2\tB2.3\t6\t11\r", "short\tline\t1"]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    hashes = cf.key_hash(cf.hash_input(frame))

    def expected(text):
        return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)

    assert rows(hashes) == sorted(
        [(expected("A1"), expected("A1.1"), "5"), (expected("B2"), expected("B2.3"), "6")], key=repr
    )
    cf.write_hashes(hashes, str(tmp_path / "hashes"))
    text = "".join(p.read_text() for p in (tmp_path / "hashes").glob("part-*"))
    assert f"{expected('A1')}\t{expected('A1.1')}\t5\n" in text


def test_key_collisions(spark):
    acc_map = spark.createDataFrame(MAP_ROWS, MAP)
    assert rows(cf.key_collisions(acc_map)) == [("B2.3", 2)]
    assert cf.key_collisions(cf.key_hash(acc_map), "acc_ver_hash").count() == 1


def test_shared_folder_setting(spark):
    from cladeframe.operators.staging import shared_folder

    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_cluster_needs_a_shared_folder():
    """Only a local master may stage tables in a folder of its own machine."""
    from types import SimpleNamespace

    from cladeframe.operators.staging import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(applicationId="app-1", master=master),
        )

    with pytest.raises(RuntimeError):
        shared_folder(session("yarn"))
    assert shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y/cladeframe/app-1"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))


def test_stage_and_remove(spark):
    from cladeframe.operators.staging import fresh_path, remove, within_broadcast

    path = fresh_path(spark)
    staged = cf.stage(spark.range(10), path)
    assert rows(staged) == [(i,) for i in range(10)]
    assert within_broadcast(staged)
    remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_read_hits(spark, tmp_path):
    (tmp_path / "hits").write_text("r1|1|ref|NC_1.1|\r\nr2|x\n")
    parsed = cf.parse_hits(cf.read_hits(spark, str(tmp_path / "hits")), "|", 3)
    assert rows(parsed, "acc_ver", "reject_reason") == sorted(
        [("NC_1.1", None), (None, "too_few_columns")], key=repr
    )


@pytest.mark.parametrize("text", ["", "\n"])
def test_empty_hit_file(spark, tmp_path, text):
    (tmp_path / "hits").write_text(text)
    parsed = cf.parse_hits(cf.read_hits(spark, str(tmp_path / "hits")))
    assert rows(cf.hit_counters(parsed)) == [(0, 0, len(text))]
