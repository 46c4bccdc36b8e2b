"""Hit lines: parse, count, and count per accession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field, is_accession, strip

TOO_FEW_COLUMNS = "too_few_columns"
PATTERN_MISS = "pattern_miss"


def parse_hits(lines: DataFrame, sep: str = "\t", col: int = 3) -> DataFrame:
    """Pull the accession out of every line: line, acc_ver, reject_reason.

    `lines` has one string column and no line ends inside. `col` counts from 0.
    `reject_reason` is null exactly where `acc_ver` is not.
    """
    line = F.col(lines.columns[0])
    # Step by step, so that each line is split and matched once.
    found = lines.select(line.alias("line"), field(line, sep, col).alias("_field"))
    text = found.withColumn("_text", strip(F.col("_field")))
    matched = text.withColumn("acc_ver", F.when(is_accession(F.col("_text")), F.col("_text")))
    return matched.select(
        "line",
        "acc_ver",
        F.when(F.col("acc_ver").isNotNull(), F.lit(None))
        .when(F.col("_field").isNull(), TOO_FEW_COLUMNS)
        .otherwise(PATTERN_MISS)
        .alias("reject_reason"),
    )


def hit_rejects(parsed: DataFrame) -> DataFrame:
    """Lines without a usable accession: line, reject_reason."""
    return parsed.where(F.col("acc_ver").isNull()).select("line", "reject_reason")


def hit_counters(parsed: DataFrame) -> DataFrame:
    """One row: unique_accessions, accepted_rows, rejected_rows."""
    return parsed.agg(
        F.count_distinct("acc_ver").alias("unique_accessions"),
        F.count("acc_ver").alias("accepted_rows"),
        F.count_if(F.col("acc_ver").isNull()).alias("rejected_rows"),
    )


def accession_frequency(parsed: DataFrame) -> DataFrame:
    """Hits per accepted accession: acc_ver, freq.

    Rejects are dropped after the aggregation, where they are one row per task; a
    filter in front of it would make Spark match every line a second time.
    """
    counted = parsed.groupBy("acc_ver").agg(F.count("acc_ver").alias("freq"))
    return counted.where(F.col("freq") > 0)
