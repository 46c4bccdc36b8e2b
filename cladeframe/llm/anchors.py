"""Content-chosen anchors: few positions of a sequence that repeated passages have in common.

An anchor is a position whose hash of `gram` tokens is the smallest within some run of
`window - gram + 1` neighbouring ones. Every stretch of `window` tokens holds an anchor
with its whole gram, and equal stretches hold equal ones at equal places. So a stretch that
occurs twice shows in anchors that do, and only those need a closer look.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xD6E8FEB86659FD93)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MORE
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, width: int, key: int) -> np.ndarray:
    """64-bit hash of every run of `width` values; built by doubling.

    Runs of a power of two are combined, so the work is logarithmic in the width.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    factor = np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 | 1)
    power, done, out, size = values.astype(np.uint64), 0, None, 1
    n = len(values) - width + 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else scramble(out * factor + part)
            done += size
        if size * 2 > width:
            return scramble(out + np.uint64(key))
        power = scramble(power[:-size] * factor + power[size:])
        size *= 2


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every run of `width` values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchor_places(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions that are smallest in some run of `run` positions; ties all count."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    order = (grams >> np.uint64(32)).astype(np.uint32)
    low = _sliding(order, run, np.minimum)
    fill = np.zeros(run - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate((fill, low, fill)), run, np.maximum) == order)


def repeated(anchors: DataFrame) -> DataFrame:
    """Anchors whose gram occurs more than once, with what is known of all its occurrences.

    `anchors` has gram, context (a hash of all that surrounds the gram) and doc_id. Adds
    `_first` (smallest doc_id with the gram) and `_contexts` (is there more than one).
    Pre-aggregated before the shuffle; the join is on a side with one row per gram.
    """
    seen = (
        anchors.groupBy("gram")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("doc_id").alias("_first"),
            F.min("context").alias("_low"),
            F.max("context").alias("_high"),
        )
        .where("_n > 1")
        .select("gram", "_first", (F.col("_low") != F.col("_high")).alias("_contexts"))
    )
    return anchors.join(seen, "gram")
