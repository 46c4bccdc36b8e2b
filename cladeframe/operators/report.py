"""Ranked report over a rollup, as a table, as text lines and as HTML rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pad_left, pad_right
from ..schemas import ACCESSION_LEVEL, LEVELS, NO_RANK
from .staging import stage

# Headings and row layouts of the printed report.
ACCESSION_HEADING = "           =================== Taxid at Accession.V =================="
LEVEL_HEADING = "           =================== Rank Level: %s  =================="
COLUMN_HEADING = "   count  percentage  Rank name                                                         [  taxid  ] (running tally)"  # noqa: E501
TEXT_ROW = "%8d  %8.4f %%    %s    [ %s ] ( %11d )"
HTML_ROW = (
    "<TR><TD>%8d</TD><TD>%8.4f %%</TD><TD>%s</TD>"
    "<TD><A HREF='http://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=%s'>\t%s</A></TD></TR>"
)
SUMMARY_ROW = "<TR><TD>%s</TD><TD>%s</TD></TR>"
SUMMARY_TITLES = (
    "Job Name:             ",
    "Job Desc:             ",
    "Unique Acc.V Count:   ",
    "Total rows processed: ",
    "Rejected rows:        ",
)
NAME_WIDTH = 60
TAXID_WIDTH = 7


def _level_number(col: str) -> Column:
    return F.array_position(F.array(*[F.lit(level) for level in LEVELS]), F.col(col)) - 1


def _level_totals(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Running sum of `value` along `order` in each level, without a task per level.

    Adds `running` (sum so far in the level), `line_no` (place in the whole table,
    levels in ascending order) and `total` (sum of the level). Rows are split into
    ranges of the full order; each range is summed by itself and starts from the
    sums of the ranges before it. `_level` takes no more than len(LEVELS) values, so
    there are at most that many such sums beside one per range: the table of them is
    as small as the number of partitions, and may be broadcast. `order` has no ties
    within a level.
    """
    group = "_level"
    ranged = stage(
        df.repartitionByRange(F.col(group), *order).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    earlier = (
        Window.partitionBy(F.lit(0))
        .orderBy(group, "_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = ranged.groupBy(group, "_slice").agg(
        F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows")
    )
    offsets = slices.select(
        F.col(group).alias("_group"),
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(whole).alias("total"),
    )
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumns(
            {"_running": F.sum(value).over(so_far), "_place": F.row_number().over(inside)}
        )
        .join(
            F.broadcast(offsets),
            (F.col(group) == F.col("_group")) & (F.col("_slice") == F.col("_of")),
        )
        .select(
            *df.columns,
            (F.col("_running") + F.col("_sum_before")).alias("running"),
            (F.col("_place") + F.col("_rows_before")).cast("bigint").alias("line_no"),
            "total",
        )
    )


def report(rollup: DataFrame) -> DataFrame:
    """Rollup rows in display order with their share and running tally.

    Levels from accession to superkingdom; within a level by falling tally, then
    name, then taxid. Columns rank_level, taxid, rank_name, mapped_rank, tally,
    percentage, running_tally, line_no (from 1).
    """
    order = [F.col("tally").desc(), F.col("rank_name"), F.col("taxid")]
    leveled = rollup.select(
        _level_number("rank_level").cast("int").alias("_level"),
        "rank_level",
        "taxid",
        "rank_name",
        "mapped_rank",
        "tally",
    )
    return _level_totals(leveled, order, "tally").select(
        "rank_level",
        "taxid",
        "rank_name",
        "mapped_rank",
        "tally",
        (F.col("tally") / F.col("total") * 100).alias("percentage"),
        F.col("running").alias("running_tally"),
        "line_no",
    )


def _display_name() -> Column:
    shown = F.when(
        F.col("rank_level") == ACCESSION_LEVEL,
        F.concat("rank_name", F.lit(" ("), F.coalesce("mapped_rank", F.lit(NO_RANK)), F.lit(")")),
    ).otherwise(F.col("rank_name"))
    return pad_right(shown, NAME_WIDTH)


def report_lines(reported: DataFrame) -> DataFrame:
    """The text report: line_no, line. Each level has two heading lines and a blank one."""
    rows = reported.select(
        (F.col("line_no") + 3 * _level_number("rank_level") + 2).alias("line_no"),
        F.format_string(
            TEXT_ROW,
            F.col("tally"),
            F.col("percentage"),
            _display_name(),
            pad_left(F.col("taxid").cast("string"), TAXID_WIDTH),
            F.col("running_tally"),
        ).alias("line"),
    )
    # One row per level, whether or not the level has rows.
    counts = [
        F.count_if(_level_number("rank_level") < number).alias(f"before_{number}")
        for number in range(len(LEVELS) + 1)
    ]
    frame = []
    for number, level in enumerate(LEVELS):
        heading = ACCESSION_HEADING if level == ACCESSION_LEVEL else LEVEL_HEADING % level
        above = F.col(f"before_{number}") + 3 * number
        below = F.col(f"before_{number + 1}") + 3 * number
        for place, text in ((above + 1, heading), (above + 2, COLUMN_HEADING), (below + 3, "")):
            frame.append(F.struct(place.alias("line_no"), F.lit(text).alias("line")))
    headings = reported.agg(*counts).select(F.inline(F.array(*frame)))
    return rows.unionByName(headings)


def report_html_rows(reported: DataFrame) -> DataFrame:
    """The report as HTML table rows: rank_level, line_no, html."""
    return reported.select(
        "rank_level",
        "line_no",
        F.format_string(
            HTML_ROW,
            F.col("tally"),
            F.col("percentage"),
            _display_name(),
            F.col("taxid").cast("string"),
            pad_left(F.col("taxid").cast("string"), TAXID_WIDTH),
        ).alias("html"),
    )


def report_summary(counters: DataFrame, job_name: str, job_desc: str) -> DataFrame:
    """What a report rests on, as HTML table rows: line_no, html.

    counters: the one row of `hit_counters`. Accepted rows show thousands separators.
    """
    values = (
        F.lit(job_name),
        F.lit(job_desc),
        F.col("unique_accessions").cast("string"),
        F.format_number("accepted_rows", 0),
        F.col("rejected_rows").cast("string"),
    )
    rows = [
        F.struct(
            F.lit(place).cast("bigint").alias("line_no"),
            F.format_string(SUMMARY_ROW, F.lit(title), value).alias("html"),
        )
        for place, (title, value) in enumerate(zip(SUMMARY_TITLES, values), 1)
    ]
    return counters.select(F.inline(F.array(*rows)))
