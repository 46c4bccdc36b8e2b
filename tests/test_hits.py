"""Parsing and counting of hit lines."""

import random
import re

import pytest
from conftest import rows

import cladeframe as cf

# Fixed value: what an accession must look like.
PATTERN = re.compile(r"^[A-Z][A-Z][_]{0,1}[0-9]+\.[0-9]+$")


def expected(line, sep, col):
    parts = line.split(sep)
    if len(parts) <= col:
        return None, "too_few_columns"
    text = parts[col].strip()
    return (text, None) if PATTERN.match(text) else (None, "pattern_miss")


def lines_frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


FIXED = [
    "read1\tgi|700100200|ref|QX_123456789.1|\t41.25\t17",
    "read2\tgi|8000001|ref| QY_654321.2 |\t12.34",
    "read3\tgi|1|gb|\tQZ135790.1\x1f|",
    "read4\tgi|1|gb|\xa0QW246801.12　|",
    "read5|1|emb|Z13579.1|",
    "read6|1|emb|F9999.9|",
    "read7|1|emb|AB__12.1|",
    "read8|1|emb|ab_12.1|",
    "read9|1|emb|AB_12|",
    "read10|1|emb|AB_12.1.2|",
    "read11|1|emb",
    "read12|1|emb|",
    "read13|1|emb|AB_١.1|",
    "x AB_12.1",
    "",
]


@pytest.mark.parametrize("sep,col", [("|", 3), ("\t", 0), ("\t", 3), (".", 1), ("||", 1), ("gi|", 1)])
def test_parse_hits(spark, sep, col):
    rng = random.Random(11)
    alphabet = ["AB_12.1", "NC_9.3", "|", "||", "\t", ".", " ", "x", "Z1.1", "gi|"]
    lines = FIXED + ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(300)]
    found = rows(cf.parse_hits(lines_frame(spark, lines), sep, col))
    assert found == sorted(((x, *expected(x, sep, col)) for x in lines), key=repr)


def test_counts_agree(spark):
    lines = FIXED * 3 + ["r|1|x|AB_7.1|"] * 50
    parsed = cf.parse_hits(lines_frame(spark, lines), "|", 3)
    good = [a for a, _ in (expected(x, "|", 3) for x in lines) if a]
    freq = {a: good.count(a) for a in good}
    assert rows(cf.accession_frequency(parsed)) == sorted(freq.items(), key=repr)
    assert rows(cf.hit_counters(parsed)) == [(len(freq), len(good), len(lines) - len(good))]
    rejects = cf.hit_rejects(parsed)
    assert rejects.count() == len(lines) - len(good)
    assert rejects.where("reject_reason IS NULL").count() == 0


@pytest.mark.parametrize("lines", [[], ["nothing", "to|see"]])
def test_nothing_accepted(spark, lines):
    parsed = cf.parse_hits(lines_frame(spark, lines), "|", 3)
    assert rows(cf.hit_counters(parsed)) == [(0, 0, len(lines))]
    assert cf.accession_frequency(parsed).count() == 0


def test_bad_options(spark):
    with pytest.raises(ValueError):
        cf.parse_hits(lines_frame(spark, []), "", 3)
    with pytest.raises(ValueError):
        cf.parse_hits(lines_frame(spark, []), "|", -1)
