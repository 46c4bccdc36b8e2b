"""Numbers are cast only where a text looks like one, and a settled scan counts lines and nothing else."""

import re

import cladeframe as cf
from cladeframe.functions import text
from cladeframe.operators import staging
from conftest import rows
from pyspark.sql import functions as F

ODD = [
    None, "", " ", "7", " 7 ", "+7", "-7", "- 7", "--7", "7-", "7.0", ".7", "7.", "1e3", "0x7", "x7", "7x", "NULL", "none",
    "\t7\r\n", "7\n", "\n7\n8", "\x007\x7f", "\x1c7\x1f", "\x857", "\xa07　", " +7 ", "​7", "　\x007", "\x00　7",
    "٧", "9223372036854775807", "-9223372036854775808", "9223372036854775808", "-9223372036854775809", "0" * 30 + "5", "9" * 400,
]


def test_whole_numbers(spark):
    """The same numbers as by a cast of every text."""
    frame = spark.createDataFrame([(t,) for t in ODD], "t string")
    both = frame.select("t", text.whole_number(F.col("t")).alias("n"), text.strip(F.col("t")).try_cast("bigint").alias("plain")).collect()
    assert [(r["t"], r["n"]) for r in both] == [(r["t"], r["plain"]) for r in both]
    found = {r["t"]: r["n"] for r in both}
    assert (found[" +7 "], found["\xa07　"], found["9223372036854775808"], found["7.0"]) == (7, 7, None, None)


def test_only_what_looks_like_a_number_is_cast(spark, tmp_path):
    """A cast that fails raises an exception in Spark, for every line without a number."""
    (tmp_path / "in").write_text("a\tb\tnone\tx1\n")
    path = str(tmp_path / "in")
    scans = [
        cf.scan_accession_map(spark, path),
        cf.scan_tree(spark, path),
        cf.scan_names(spark, path),
        cf.scan_nodes(spark, path),
        cf.scan_hash_lines(spark.read.text(path)),
    ]
    for scan in scans:
        plan = scan._jdf.queryExecution().optimizedPlan().toString()
        casts = [m.start() for m in re.finditer(r"try_cast\(", plan)]
        assert casts
        assert all(plan[:at].endswith("THEN ") for at in casts)


def test_settle_measures_no_widths(spark, tmp_path, monkeypatch):
    def refuse(df):
        raise AssertionError("widths of rows are measured")

    monkeypatch.setattr(staging, "row_width", refuse)
    (tmp_path / "map").write_text("accession\taccession.version\ttaxid\tgi\nA\tA.1\t5\t1\nA\tA.1\tfive\t1\nB\n")
    both = cf.settle(cf.scan_accession_map(spark, str(tmp_path / "map"), headers=True))
    assert rows(both.kept) == [("A", "A.1", 5, 1)]
    assert rows(both.rejects) == [("A\tA.1\tfive\t1", "bad_taxid"), ("B", "wrong_columns")]
    assert (both.n_kept, both.n_rejects, both.n_headers) == (1, 2, 1)


def test_verdicts_store_no_places(spark, monkeypatch):
    """Places in files are wide and nobody asks for them there."""
    from cladeframe.plans import queries

    columns, plain = [], cf.settle
    monkeypatch.setattr(cf, "settle", lambda scanned: columns.append(scanned.columns) or plain(scanned))
    queries.line_verdicts(spark, "/root/testdata/sf0.001")
    assert len(columns) == 5 and not any("position" in names for names in columns)
