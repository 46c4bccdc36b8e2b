"""File sources with fixed schemas; nothing is inferred.

Every reader takes one path or several, files or folders, compressed or not.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chomp, strip, whole_number
from ..schemas import ACCESSION_MAP, TREE

# Fixed value: first word of the header line in accession files.
HEADER_WORD = "accession"
# Why a line is left out.
WRONG_COLUMNS, BAD_TAXID, BAD_PARENT, BAD_GI = "wrong_columns", "bad_taxid", "bad_parent", "bad_gi"
# What a line is that is neither kept nor refused.
HEADER = "header"
# Fixed value: the class of names that go into the tree.
SCIENTIFIC_NAME = "scientific name"


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _file_order() -> Column:
    """Sorts rows as they stand in their files, files by path."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def _without_headers(lines: DataFrame, header: Column, reason: Column, keep: bool) -> DataFrame:
    """Judged lines, headers left out or marked as such."""
    if keep:
        return lines.withColumn("reject_reason", F.when(header, HEADER).otherwise(reason))
    return lines.where(~header).withColumn("reject_reason", reason)


def read_hits(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hit files, one line per row: value."""
    return spark.read.text(_paths(paths))


def scan_accession_map(
    spark: SparkSession, paths: str | Sequence[str], headers: bool = False
) -> DataFrame:
    """Every line of accession files but headers: acc, acc_ver, taxid, gi, line, reject_reason.

    With `headers` they are there too, with reason `header`. A header is a line whose first field is exactly the header word and whose taxid is no
    number. Lines without four fields, or without a number where one must be, have a
    reason and no values; an empty or NULL gi is none. An empty first field is kept.
    """
    parts = spark.read.text(_paths(paths)).select(
        F.col("value").alias("line"), F.split(chomp(F.col("value")), "\t").alias("_f")
    )
    named = parts.select(
        "line",
        F.size("_f").alias("_n"),
        F.get("_f", F.lit(0)).alias("acc"),
        strip(F.get("_f", F.lit(1))).alias("acc_ver"),
        F.get("_f", F.lit(2)).alias("_taxid"),
        F.get("_f", F.lit(3)).alias("_gi"),
    ).withColumns({"taxid": whole_number(F.col("_taxid")), "gi": whole_number(F.col("_gi"))})
    header = F.coalesce(F.col("acc"), F.lit("")) == HEADER_WORD
    no_gi = F.upper(strip(F.col("_gi"))).isin("", "NULL")
    reason = (
        F.when(F.col("_n") != 4, WRONG_COLUMNS)
        .when(F.col("taxid").isNull(), BAD_TAXID)
        .when(F.col("gi").isNull() & ~no_gi, BAD_GI)
    )
    judged = _without_headers(named, header & F.col("taxid").isNull(), reason, headers)
    return judged.select(
        *[F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) for c in ACCESSION_MAP.names],
        "line",
        "reject_reason",
    )


def read_accession_map(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Accession files in one table: acc, acc_ver, taxid, gi. See `accession_rejects`."""
    return scan_accession_map(spark, paths).where("reject_reason is null").select(*ACCESSION_MAP.names)


def accession_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines that `read_accession_map` leaves out, headers aside: line, reject_reason."""
    scanned = scan_accession_map(spark, paths)
    return scanned.where("reject_reason is not null").select("line", "reject_reason")


def scan_tree(spark: SparkSession, paths: str | Sequence[str], headers: bool = False) -> DataFrame:
    """Every record of a quoted tree CSV but headers: taxid, name, parent, rank, line, reject_reason.

    With `headers` they are there too, with reason `header`. A header is a record that holds exactly the column names. Records without four
    fields, or without a number as taxid or parent, have a reason and no values. An
    empty field is an empty text, not null.
    """
    text = [T.StructField(name, T.StringType()) for name in (*TREE.names, "_whole")]
    rows = spark.read.csv(
        _paths(paths),
        quote='"',
        escape='"',
        schema=T.StructType(text),
        columnNameOfCorruptRecord="_whole",
    )
    header = F.lit(True)
    for name in TREE.names:
        header = header & (F.coalesce(F.col(name), F.lit("")) == name)
    named = rows.withColumns(
        {
            "_id": whole_number(F.col("taxid")),
            "_parent": whole_number(F.col("parent")),
            "_fields": F.concat_ws(",", *[F.coalesce(name, F.lit("")) for name in TREE.names]),
        }
    )
    reason = (
        F.when(F.col("_whole").isNotNull(), WRONG_COLUMNS)
        .when(F.col("_id").isNull(), BAD_TAXID)
        .when(F.col("_parent").isNull(), BAD_PARENT)
    )
    judged = _without_headers(named, header, reason, headers)
    good = F.col("reject_reason").isNull()
    return judged.select(
        F.when(good, F.col("_id")).alias("taxid"),
        F.when(good, F.coalesce("name", F.lit(""))).alias("name"),
        F.when(good, F.col("_parent")).alias("parent"),
        F.when(good, F.coalesce("rank", F.lit(""))).alias("rank"),
        F.coalesce("_whole", "_fields").alias("line"),
        "reject_reason",
    )


def read_tree(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tree as quoted CSV, with or without header lines: taxid, name, parent, rank.

    See `tree_rejects`.
    """
    return scan_tree(spark, paths).where("reject_reason is null").select(*TREE.names)


def tree_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records that `read_tree` leaves out, headers aside: line, reject_reason.

    `line` is the record as it stands, or its fields joined by commas if their number is right.
    """
    return scan_tree(spark, paths).where("reject_reason is not null").select("line", "reject_reason")


def _scan_dump(spark: SparkSession, paths: str | Sequence[str], fields: int) -> DataFrame:
    """Lines of a dump: line, position, _f (its TAB fields), _whole (are field ends where they belong?).

    A field of a dump ends in TAB, bar, TAB, the last one in TAB and bar. So every second TAB field
    is a bar; one that is not tells of a field too few, too many or with a TAB in it.
    """
    lines = spark.read.text(_paths(paths)).select(F.col("value").alias("line"), _file_order().alias("position"))
    parts = lines.withColumn("_f", F.split(chomp(F.col("line")), "\t"))
    needed = 2 * fields - 1
    whole = F.size("_f") >= needed
    for i in range(1, needed + 1, 2):
        whole = whole & (F.coalesce(F.get("_f", F.lit(i)), F.lit("|")) == "|")
    return parts.withColumn("_whole", whole)


def scan_names(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of a names dump: taxid, name, name_class, position, line, reject_reason.

    A line without four fields, or without a number as taxid, has a reason and no values.
    """
    parts = _scan_dump(spark, paths, 4).withColumn("_id", whole_number(F.get("_f", F.lit(0))))
    reason = F.when(~F.col("_whole"), WRONG_COLUMNS).when(F.col("_id").isNull(), BAD_TAXID)
    judged = parts.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return judged.select(
        F.when(good, F.col("_id")).alias("taxid"),
        F.when(good, F.get("_f", F.lit(2))).alias("name"),
        F.when(good, F.get("_f", F.lit(6))).alias("name_class"),
        "position",
        "line",
        "reject_reason",
    )


def scan_nodes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of a nodes dump: taxid, parent, rank, position, line, reject_reason.

    Only the first three fields are used. A line without them, or without a number as taxid or
    parent, has a reason and no values.
    """
    parts = _scan_dump(spark, paths, 3).withColumns(
        {"_id": whole_number(F.get("_f", F.lit(0))), "_parent": whole_number(F.get("_f", F.lit(2)))}
    )
    reason = (
        F.when(~F.col("_whole"), WRONG_COLUMNS)
        .when(F.col("_id").isNull(), BAD_TAXID)
        .when(F.col("_parent").isNull(), BAD_PARENT)
    )
    judged = parts.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return judged.select(
        F.when(good, F.col("_id")).alias("taxid"),
        F.when(good, F.col("_parent")).alias("parent"),
        F.when(good, F.get("_f", F.lit(4))).alias("rank"),
        "position",
        "line",
        "reject_reason",
    )


def _kept(scanned: DataFrame) -> DataFrame:
    return scanned.where("reject_reason is null").drop("line", "reject_reason")


def _refused(scanned: DataFrame) -> DataFrame:
    return scanned.where("reject_reason is not null").select("line", "reject_reason")


def read_names(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Names dump: taxid, name, name_class, position (order in the files). See `names_rejects`."""
    return _kept(scan_names(spark, paths))


def names_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines that `read_names` leaves out: line, reject_reason."""
    return _refused(scan_names(spark, paths))


def read_nodes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Nodes dump: taxid, parent, rank, position (order in the files). See `nodes_rejects`."""
    return _kept(scan_nodes(spark, paths))


def nodes_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines that `read_nodes` leaves out: line, reject_reason."""
    return _refused(scan_nodes(spark, paths))


def build_tree(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tree from the two dumps: the first scientific name and the last node per taxid.

    A name without a node gets parent 0 and an empty rank. Both sides come out of an
    aggregation on taxid, so the join needs no further shuffle and has no hot key.
    """
    named = (
        names.where((F.col("name_class") == SCIENTIFIC_NAME) & F.col("taxid").isNotNull())
        .groupBy("taxid")
        .agg(F.min_by("name", "position").alias("name"))
    )
    placed = nodes.groupBy("taxid").agg(
        F.max_by(F.struct("parent", "rank"), "position").alias("node")
    )
    return named.join(placed, "taxid", "left").select(
        "taxid",
        "name",
        F.coalesce("node.parent", F.lit(0)).cast("bigint").alias("parent"),
        F.coalesce("node.rank", F.lit("")).alias("rank"),
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A trace table written earlier."""
    return spark.read.parquet(path)


def scan_hash_lines(lines: DataFrame, sep: str = "\t", headers: bool = False) -> DataFrame:
    """Lines for key hashing but headers: acc, acc_ver, taxid (as text), line, reject_reason.

    A line needs four fields; what stands in them does not matter. A header is what it is in
    accession files; with `headers` it is there too, with reason `header`.
    """
    text = F.col(lines.columns[0])
    parts = lines.select(text.alias("line"), F.split(chomp(text), re.escape(sep)).alias("_f"))
    fields = [F.get("_f", F.lit(i)) for i in range(3)]
    header = (fields[0] == HEADER_WORD) & whole_number(fields[2]).isNull()
    reason = F.when(F.size("_f") < 4, WRONG_COLUMNS)
    judged = _without_headers(parts, F.coalesce(header, F.lit(False)), reason, headers)
    good = F.col("reject_reason").isNull()
    names = ("acc", "acc_ver", "taxid")
    return judged.select(
        *[F.when(good, value).alias(name) for name, value in zip(names, fields, strict=True)],
        "line",
        "reject_reason",
    )


def hash_input(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Lines fit for key hashing: acc, acc_ver, taxid of lines with four fields. See `hash_rejects`."""
    return _kept(scan_hash_lines(lines, sep))


def hash_rejects(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Lines that `hash_input` leaves out, headers aside: line, reject_reason."""
    return _refused(scan_hash_lines(lines, sep))
