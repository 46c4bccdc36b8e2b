"""Text expressions for hit lines and delimited files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; trim() alone removes only blanks.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Fixed value: what a cast to a whole number takes, and the same between white space of any kind.
NUMBER_PATTERN = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*\z"
SPACED_NUMBER_PATTERN = r"^[\x00-\x20\x7F{0}]*[+-]?[0-9]+[\x00-\x20\x7F{0}]*\z".format(
    "".join(f"\\u{ord(c):04X}" for c in WHITESPACE if ord(c) > 0x7F)
)

# Fixed value: the accession.version pattern, anchored to the whole field.
ACCESSION_PATTERN = r"^[A-Z][A-Z]_?[0-9]+\.[0-9]+\z"


def strip(col: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def chomp(col: Column) -> Column:
    """Remove line ends on the right."""
    return F.rtrim(col, F.lit("\r\n"))


def whole_number(col: Column) -> Column:
    """The text as BIGINT without white space around it; null if it is no number or too large.

    A cast that fails raises an exception within Spark, which costs more than reading the line, so
    only what looks like a number is cast.
    """
    return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("bigint")).when(
        col.rlike(SPACED_NUMBER_PATTERN), strip(col).try_cast("bigint")
    )


def field(line: Column, sep: str, index: int) -> Column:
    """Field `index` (from 0) of a line split on the literal `sep`; null if absent.

    The split stops right after the wanted field, however long the line is.
    """
    if not sep:
        raise ValueError("empty separator")
    if index < 0:
        raise ValueError("field index must not be negative")
    return F.get(F.split(line, re.escape(sep), index + 2), F.lit(index))


def is_accession(col: Column) -> Column:
    """Does the text look like accession.version?"""
    return col.rlike(ACCESSION_PATTERN)


def pad_right(col: Column, width: int) -> Column:
    """Left-align to at least `width` characters; never cuts."""
    return F.rpad(col, F.greatest(F.length(col), F.lit(width)), F.lit(" "))


def pad_left(col: Column, width: int) -> Column:
    """Right-align to at least `width` characters; never cuts."""
    return F.lpad(col, F.greatest(F.length(col), F.lit(width)), F.lit(" "))
