"""Judge a file once and keep both outcomes: one scan, two outputs, and how many lines went where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.staging import fresh_path
from .readers import HEADER

KEPT, REFUSED = "kept", "refused"


@dataclass(frozen=True)
class Settled:
    """Rows kept and lines refused of one scan, and the number of lines of each kind."""

    kept: DataFrame
    rejects: DataFrame
    n_kept: int
    n_rejects: int
    n_headers: int

    @property
    def n_lines(self) -> int:
        return self.n_kept + self.n_rejects + self.n_headers


def settle(scanned: DataFrame, path: str | None = None) -> Settled:
    """Write what a scan (line, reject_reason and values) kept and refused into folders of their own.

    The files are read once; each outcome is then read by itself, and its lines are counted while
    they are written. Headers, if the scan marks them, are counted only. `path` is where to keep
    the result; else it is staged.
    """
    reason = F.col("reject_reason")
    is_header = F.coalesce(reason == HEADER, F.lit(False))
    verdict = F.when(reason.isNull(), KEPT).when(is_header, HEADER).otherwise(REFUSED)
    judged = scanned.withColumns({"line": F.when(reason.isNotNull(), F.col("line")), "verdict": verdict})
    own, spark = F.col("verdict"), scanned.sparkSession
    path = path or fresh_path(spark)
    # Lines are counted and nothing else: widths of rows cost more than the counts and nobody asks for them.
    seen = Observation()
    counts = [F.count_if(own == v).alias(v) for v in (KEPT, REFUSED, HEADER)]
    judged.observe(seen, *counts).write.partitionBy("verdict").parquet(path)
    written = spark.read.schema(judged.schema).parquet(path)
    values = [c for c in scanned.columns if c not in ("line", "reject_reason")]
    found = seen.get
    return Settled(
        written.where(own == KEPT).select(values),
        written.where(own == REFUSED).select("line", "reject_reason"),
        found[KEPT],
        found[REFUSED],
        found[HEADER],
    )
