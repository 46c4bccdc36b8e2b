"""Find what repeats among very many keys without shuffling the keys that do not.

Two passes. The first hashes every key to one of 2^44 cells; each task sorts its cells and
sends them packed, four bytes a key, to the task that owns their stripe, which tells the
cells met more than once. A key that repeats always lies in such a cell, so the second pass
deals exactly with the rows of those cells, and only they are shuffled as rows.

Where so much repeats that the cells cannot be broadcast, `may_repeat` sends bits of them
instead: a filter of bounded size that lets every row of such a cell through, and few others.

Null is a key like any other. Rows are read twice; where that is dear, stage them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import counted, derived, stage, within_broadcast

# Parts that the cells are shuffled in; each has 2^32 cells. One stripe at a time is in memory.
STRIPES = 4096
# Keys that a task sorts at once.
BUFFER = 1 << 22
# Bits of a cell's number.
CELL_BITS = 44
# Bits of a filter for each cell in it; the powers of two of its largest size and of a page of it.
FILTER_SHARE = 16
FILTER_MOST, FILTER_PAGE = 29, 18

_PLACE = "__place"
_PACKED = "stripe int, cells binary, again binary"


def _place(key: str) -> Column:
    """The cell of a key: 12 bits that name its stripe, then 32."""
    return F.xxhash64(F.lit(0), F.col(key)).bitwiseAND(F.lit((STRIPES << 32) - 1))


def _packed(places: np.ndarray) -> pa.RecordBatch:
    """Cells by stripe: each once, and those met more than once."""
    cells, n = np.unique(places, return_counts=True)
    stripes, first = np.unique(cells >> 32, return_index=True)
    low = (cells & 0xFFFFFFFF).astype(np.uint32)
    ends = [*first[1:], len(cells)]
    parts = [slice(a, b) for a, b in zip(first, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(stripes.astype(np.int32)),
            pa.array([low[own].tobytes() for own in parts], pa.binary()),
            pa.array([low[own][n[own] > 1].tobytes() for own in parts], pa.binary()),
        ],
        ["stripe", "cells", "again"],
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += len(held[-1])
        if n >= BUFFER:
            yield _packed(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _packed(np.concatenate(held))


def _merged(stripe: int, cells: list[bytes], again: list[bytes]) -> pa.RecordBatch:
    met = np.sort(np.frombuffer(b"".join(cells), np.uint32))
    twice = met[1:][met[1:] == met[:-1]]
    found = np.union1d(twice, np.frombuffer(b"".join(again), np.uint32))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64) + (stripe << 32))], [_PLACE])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells met more than once, stripe by stripe; rows come in the order of their stripes."""
    stripe, cells, again = None, [], []
    for batch in batches:
        for own, part, repeated in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if own != stripe and stripe is not None:
                yield _merged(stripe, cells, again)
                cells, again = [], []
            stripe = own
            cells.append(part)
            again.append(repeated)
    if stripe is not None:
        yield _merged(stripe, cells, again)


def _repeated_cells(df: DataFrame, key: str) -> DataFrame:
    """Cells in which more than one row of `df` lies, as a staged table."""
    packed = df.select(_place(key).alias(_PLACE)).mapInArrow(_pack, _PACKED)
    dealt = packed.repartition("stripe").sortWithinPartitions("stripe")
    return stage(dealt.mapInArrow(_merge, f"{_PLACE} bigint"))


def split_repeats(df: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame]:
    """`df` in two parts: rows whose key is proven to occur once, and all others.

    Nothing of `df` is shuffled for it. Cells are broadcast if their counted size allows it;
    if not, so much repeats that nothing is proven: the first part is None, the second all of `df`.
    """
    cells = _repeated_cells(df, key)
    if not within_broadcast(cells):
        return None, df
    small = F.broadcast(derived(cells, cells))
    placed = df.withColumn(_PLACE, _place(key))
    return (
        placed.join(small, _PLACE, "left_anti").drop(_PLACE),
        placed.join(small, _PLACE, "left_semi").drop(_PLACE),
    )


def _filter_bits(cells: DataFrame, power: int) -> np.ndarray:
    """2^power bits, of which two are set for each of the cells; pages of them are made by tasks."""
    low, high = F.col(_PLACE).bitwiseAND(F.lit((1 << power) - 1)), F.shiftright(F.col(_PLACE), CELL_BITS - power)
    spots = cells.select(F.explode(F.array(low, high)).alias("spot"))

    def page_of(page: int, bits: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int64()), "bits": pa.array([packed], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, bits = None, None
        for batch in batches:
            spot = batch.column(0).to_numpy()
            own = spot >> FILTER_PAGE
            for at in np.unique(own):
                if at != page:
                    if page is not None:
                        yield page_of(page, bits)
                    page, bits = int(at), np.zeros(1 << FILTER_PAGE, bool)
                bits[spot[own == at] & ((1 << FILTER_PAGE) - 1)] = True
        if page is not None:
            yield page_of(page, bits)

    dealt = spots.withColumn("page", F.shiftright("spot", FILTER_PAGE)).repartition("page").sortWithinPartitions("page")
    found = np.zeros(1 << power >> 3, np.uint8)
    size = 1 << FILTER_PAGE >> 3
    for row in dealt.select("spot").mapInArrow(run, "page bigint, bits binary").collect():
        found[row["page"] * size :][:size] = np.frombuffer(row["bits"], np.uint8)
    return found


def may_repeat(df: DataFrame, key: str) -> DataFrame:
    """All rows of `df` whose key repeats, and few of the others; nothing of `df` is shuffled for it.

    What is sent to every executor is a filter of two bytes for each repeated cell, of 64 MB at most: with
    more than some 3e7 repeated cells more of the other rows pass, and none that repeats is lost.
    """
    cells = _repeated_cells(df, key)
    power = min(FILTER_MOST, max(FILTER_PAGE, (FILTER_SHARE * counted(cells).rows).bit_length()))
    sent = df.sparkSession.sparkContext.broadcast(_filter_bits(cells, power))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            cell = batch.column(batch.num_columns - 1).to_numpy()
            hit = np.ones(len(cell), np.uint8)
            for spot in (cell & ((1 << power) - 1), cell >> (CELL_BITS - power)):
                hit &= bits[spot >> 3] >> (spot & 7).astype(np.uint8)
            kept = batch.filter(pa.array((hit & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return df.withColumn(_PLACE, _place(key)).mapInArrow(run, df.schema)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of `key` that occur more than once: the key, n_rows."""
    _, others = split_repeats(df.select(key), key)
    return others.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per `key`: the one with the smallest `order`, nulls first, ties to the smallest row.

    Ties compare the other columns from left to right, so these must have an order. Rows whose
    key does not repeat stay where they are.
    """
    others = [c for c in df.columns if c not in (key, order)]
    once, rest = split_repeats(df, key)
    row = F.min(F.struct(order, *others)).alias("__row")
    first = rest.groupBy(key).agg(row).select(key, *[F.col("__row")[c].alias(c) for c in (order, *others)])
    first = first.select(df.columns)
    return first if once is None else once.unionByName(first)
