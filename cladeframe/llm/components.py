"""Distributed connected components, and work on all pairs of a group in bounded cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.staging import stage


def components(links: DataFrame) -> DataFrame:
    """Smallest id that each id of `links` (a, b) reaches, as (id, component).

    Every round each node moves to the smallest of its neighbours and itself, in a hashed
    order of ids, and links follow; links within one place vanish. In hashed order a
    chain shrinks by a constant factor a round. All state is in staged tables, hubs are
    pre-aggregated, and joins are on one-row-per-key sides.
    """
    mixed = stage(links.where("a <> b").select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"), "a", "b"))
    both = mixed.select("u", F.col("a").alias("id")).unionByName(mixed.select(F.col("v").alias("u"), F.col("b").alias("id")))
    places = stage(both.groupBy("id").agg(F.min("u").alias("at")))
    edges = mixed.select("u", "v")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves = stage(ends.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("to")))
        left = moves.select(F.col("u"), F.col("to").alias("_a"))
        right = moves.select(F.col("u").alias("v"), F.col("to").alias("_b"))
        edges = stage(
            edges.join(left, "u")
            .join(right, "v")
            .where("_a <> _b")
            .select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
            .distinct()
        )
        places = stage(
            places.join(moves.withColumnRenamed("u", "at"), "at", "left").select(
                "id", F.coalesce("to", "at").alias("at")
            )
        )
    least = places.groupBy("at").agg(F.min("id").alias("component"))
    return places.join(least, "at").select("id", "component")


def cells(items: DataFrame, bucket: Column, item: str, weight: Column, most: int) -> DataFrame:
    """Deal buckets of items to cells so that every pair of a bucket meets in just one cell.

    A bucket heavier than `most` is cut into blocks by hash; a cell holds two blocks, or
    one with itself. Items alone in their bucket are left out. Adds `_bucket`, `_lo`,
    `_hi` (the cell) and `_block`.
    """
    keyed = items.withColumn("_bucket", bucket)
    sizes = (
        keyed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
        .where("_n > 1")
        .select("_bucket", F.ceil(F.col("_w") / most).cast("int").alias("_blocks"))
    )
    dealt = keyed.join(sizes, "_bucket").withColumn(
        "_block", F.pmod(F.xxhash64(F.lit(5), item), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        dealt.withColumn("_other", other)
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_other", "_blocks")
    )


def block_cells(items: DataFrame, item: str, most: int) -> DataFrame:
    """The same for items with their `_bucket` (a number), of which none is moved to be counted.

    Only buckets of more than `most` items are looked up. Items alone in their bucket stay.
    """
    heavy = stage(
        items.groupBy("_bucket")
        .agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_blocks"))
        .where("_blocks > 1")
        .withColumnRenamed("_bucket", "_heavy")
    )
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = (
        lookup(items, heavy, "_bucket", "_heavy")
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(5), item), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    return (
        dealt.withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_heavy", "_blocks", "_other")
    )


def in_cells(dealt: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply `work` to the rows of each cell; small cells are many to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(pieces).combine_chunks()
            edges = np.concatenate(([0], breaks(table), [table.num_rows]))
            results = [work(table.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield from pa.concat_tables(results).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cut = breaks(batch)
            if held and not same_cell(held[-1], batch):
                yield from done(held)
                held = []
            if len(cut):
                yield from done([*held, batch.slice(0, int(cut[-1]))])
                held = [batch.slice(int(cut[-1]))]
            else:
                held.append(batch)
        if held:
            yield from done(held)

    names = ["_bucket", "_lo", "_hi"]

    def breaks(rows) -> np.ndarray:
        changed = np.zeros(max(0, rows.num_rows - 1), bool)
        for name in names:
            values = np.asarray(rows.column(name))
            changed |= values[1:] != values[:-1]
        return np.flatnonzero(changed) + 1

    def same_cell(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(n)[a.num_rows - 1] == b.column(n)[0] for n in names)

    placed = dealt.repartition("_bucket", "_lo", "_hi").sortWithinPartitions("_bucket", "_lo", "_hi")
    return placed.mapInArrow(run, schema)


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row of a symmetric boolean matrix reaches within it."""
    root = np.asarray(ids).copy()
    while len(root):
        near = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, near)
        if (new == root).all():
            break
        root = new
    return root
