"""Sinks: Parquet tables, delimited text, reports and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RANK_FOLDER, RANK_MARK


def write_trace(trace: DataFrame, path: str, rank: str | None = None) -> None:
    """Trace table, or only its rows of one rank, as Parquet; replaces what was there."""
    kept = trace if rank is None else trace.where(F.col("rank") == rank)
    kept.write.mode("overwrite").parquet(path)


def write_tree(tree: DataFrame, path: str) -> None:
    """Tree as Parquet."""
    tree.write.mode("overwrite").parquet(path)


def write_tree_csv(tree: DataFrame, path: str) -> None:
    """Tree as quoted CSV with a header line per file."""
    tree.select("taxid", "name", "parent", "rank").write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"'
    )


def write_accession_map(acc_map: DataFrame, path: str) -> None:
    """Accession map as Parquet for repeated lookups.

    Rows are ranged and sorted on acc_ver, so equal keys sit together and row groups
    have narrow bounds; a bloom filter per row group lets a lookup of one key skip
    the rest. Copies of a key are sorted apart by taxid and gi.
    """
    order = ["acc_ver", "taxid", "gi"]
    (
        acc_map.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#acc_ver", "true")
        .parquet(path)
    )


def save_accession_table(acc_map: DataFrame, name: str, buckets: int, spread: int = 1) -> None:
    """Accession map as a table bucketed on acc_ver, rows that repeat included.

    Joins and aggregations on acc_ver then read the map without shuffling it, once
    per bucket. Use it where many reports run against one map. Rows are dealt to tasks by their
    bucket, so that a bucket is one file; `spread` deals those of every bucket to so many tasks
    and files, for maps in which one accession has very many rows.
    """
    salt = F.pmod(F.xxhash64(*acc_map.columns), F.lit(spread))
    dealt = acc_map.repartition(buckets * spread, F.pmod(F.hash("acc_ver"), F.lit(buckets)), salt)
    dealt.write.mode("overwrite").bucketBy(buckets, "acc_ver").sortBy("acc_ver").saveAsTable(name)


def save_trace_table(trace: DataFrame, name: str, buckets: int) -> None:
    """Trace table bucketed on taxid, of which it has one row each; joins on taxid do not shuffle it."""
    dealt = trace.repartition(buckets, F.pmod(F.hash("taxid"), F.lit(buckets)))
    dealt.write.mode("overwrite").bucketBy(buckets, "taxid").sortBy("taxid").saveAsTable(name)


def write_trace_store(trace: DataFrame, path: str) -> None:
    """Trace table for filters by rank and by taxid: a folder a rank, ranged on taxid inside.

    Only the folders of ranks that `trace` holds are replaced, so one rank can be written again
    alone. Files hold narrow ranges of taxid and a bloom filter each. The folder's name is the
    rank with a mark in front, as an empty rank has no folder; `rank` itself stays a column.
    """
    placed = trace.withColumn(RANK_FOLDER, F.concat(F.lit(RANK_MARK), F.coalesce("rank", F.lit(""))))
    (
        placed.repartitionByRange(RANK_FOLDER, "taxid")
        .sortWithinPartitions(RANK_FOLDER, "taxid")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#taxid", "true")
        .partitionBy(RANK_FOLDER)
        .parquet(path)
    )


def write_hashes(hashes: DataFrame, path: str) -> None:
    """Hashed map as TAB-separated text without a header."""
    hashes.select("acc_hash", "acc_ver_hash", "taxid").write.mode("overwrite").csv(path, sep="\t")


def write_lines(lines: DataFrame, path: str, order: str = "line_no", text: str = "line") -> None:
    """Text in line order across the part files; no task sorts the whole."""
    lines.orderBy(order).select(text).write.mode("overwrite").text(path)


def register(df: DataFrame, name: str) -> None:
    """Make a table known to Spark SQL under a name."""
    df.createOrReplaceTempView(name)
