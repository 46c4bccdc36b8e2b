"""Word-level expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
# A plain word, for matching that looks past case and punctuation.
NOT_PLAIN = r"[^\p{L}\p{N}]+"


def word_count(text: Column) -> Column:
    """Words in `text`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words of `text`, unchanged and in order; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_PLAIN)
    return F.filter(parts, lambda w: w != "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many `_` in front as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
