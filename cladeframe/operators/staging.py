"""Cut lineage by writing intermediate tables to the cluster's shared folder.

A staged table survives the loss of any executor and is columnar. While it is written,
its rows and their widths in memory are counted; only that count can prove that a table
is small enough to be broadcast. Its size on disk proves nothing: it is compressed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a row, of a value of fixed width, and of any other beside what it holds.
ROW_BYTES, FIXED_BYTES, VALUE_BYTES = 48, 8, 16


@dataclass(frozen=True)
class Counted:
    """What was counted while a table was written, and in `parts` of it."""

    rows: int
    total_bytes: int
    widest_row: int
    measures: dict = field(default_factory=dict)
    parts: dict = field(default_factory=dict)

    def __add__(self, other: Counted) -> Counted:
        return Counted(
            self.rows + other.rows, self.total_bytes + other.total_bytes, max(self.widest_row, other.widest_row)
        )


_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
_scopes: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a local master may do without that setting; it gets a temporary folder
    which goes away with the process.
    """
    app = spark.sparkContext.applicationId
    inner = f"/{_scopes[app]}" if app in _scopes else ""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/cladeframe/{app}{inner}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="cladeframe-")
    return _local_folders[app].name + inner


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _width(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, from above."""
    none = F.lit(VALUE_BYTES).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + none
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(
            F.coalesce(col, F.array().cast(kind)), none, lambda sum_, x: sum_ + _width(x, kind.elementType)
        )
        if isinstance(kind.elementType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)):
            inner = F.coalesce(F.size(col), F.lit(0)) * 8 + none
        return inner
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(col), T.ArrayType(kind.keyType)) + _width(F.map_values(col), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        total = none
        for field in kind.fields:
            total = total + _width(col[field.name], field.dataType)
        return total
    return F.lit(FIXED_BYTES).cast("long")


def row_width(df: DataFrame) -> Column:
    """Bytes of a row in memory, from above."""
    width = F.lit(ROW_BYTES).cast("long")
    for column in df.schema.fields:
        width = width + _width(F.col(f"`{column.name}`"), column.dataType)
    return width


def stage(
    df: DataFrame,
    path: str | None = None,
    parts: Mapping[str, Column] | None = None,
    by: str | None = None,
    **measures: Column,
) -> DataFrame:
    """Write `df` once and return the written table, with its size counted on the way.

    `parts` are conditions; the rows that meet one are counted by themselves, see `part_of`.
    `by` is a column whose values get folders of their own; it comes last in what is returned.
    `measures` are further aggregates to take along.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark)
    width = row_width(df)
    counts = [F.count(F.lit(1)).alias("rows"), F.sum(width).alias("total"), F.max(width).alias("widest")]
    for name, condition in (parts or {}).items():
        own = F.when(condition, width)
        counts += [F.count(own).alias(f"rows {name}"), F.sum(own).alias(f"total {name}"), F.max(own).alias(f"widest {name}")]
    seen = Observation()
    writer = df.observe(seen, *counts, *[value.alias(name) for name, value in measures.items()]).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    schema = T.StructType(sorted(df.schema.fields, key=lambda f: f.name == by))
    staged = spark.read.schema(schema).parquet(path)
    found = seen.get

    def known(mark: str) -> tuple:
        return found[f"rows{mark}"], found[f"total{mark}"] or 0, found[f"widest{mark}"] or 0

    taken = {name: found[name] for name in measures}
    inner = {name: Counted(*known(f" {name}")) for name in parts or {}}
    staged._counted = Counted(*known(""), taken, inner)
    return staged


def sized(df: DataFrame, known: Counted | None) -> DataFrame:
    """Say what bounds the size of `df`."""
    df._counted = known
    return df


def part_of(staged: DataFrame, name: str, condition: Column) -> DataFrame:
    """The rows of a staged table that meet the condition counted as its part `name`."""
    return sized(staged.where(condition), counted(staged).parts[name])


def counted(df: DataFrame) -> Counted | None:
    """What is known of a staged table, or of one `derived` from it."""
    return getattr(df, "_counted", None)


def derived(df: DataFrame, source: DataFrame) -> DataFrame:
    """Say that `df` holds only rows and columns of `source`, so that its size bounds `df`'s."""
    return sized(df, counted(source))


def remove(spark: SparkSession, path: str) -> None:
    """Delete one staged table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has staged; its results must be saved by then."""
    remove(spark, shared_folder(spark))


def threshold(spark: SparkSession) -> int:
    """The session's own limit for broadcasts, in bytes."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def within_broadcast(df: DataFrame) -> bool:
    """Is `df` proven to be small enough to be sent to every executor?

    Only a staged table, or one derived from it, can be: rows and widths were counted.
    """
    known = counted(df)
    return known is not None and known.total_bytes <= threshold(df.sparkSession)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block when it ends, however it ends.

    Results that read staged tables must be saved by then. Scopes do not nest.
    """
    app = spark.sparkContext.applicationId
    if app in _scopes:
        raise RuntimeError("a scope is open already")
    _scopes[app] = uuid.uuid4().hex
    folder = shared_folder(spark)
    try:
        yield
    finally:
        remove(spark, folder)
        del _scopes[app]
