"""Embedding near-dedup: random-hyperplane sign hashing in several tables.

Vectors with equal labels that share the signs of `bits` random projections in any table
meet in a bucket. What travels once per table is not the vector but its code, one byte a
number. A code bounds the angle to its vector, so pairs that may be within the threshold
are known without loss; each bucket returns one link per vector that has such a pair.
Connected components of these links are the groups in which all pairs are compared by
exact cosine in double precision: each vector travels to its group in its own type, and a
pair meets once. Connected components of the exact links are the result. The number of
bits follows the size of the largest label, the number of tables the recall that is asked
for at the threshold.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite number
link with nothing, nor do those with a null label or id; vectors of unequal length never
link. Rows that repeat a vec_id count as several vectors and share their links. Equal
vectors are compared once as a class. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .components import block_cells, components, in_cells, local_roots
from .samples import flat_lists

COSINE = 0.93
# Chance that a pair right at the threshold is found; nearer pairs are found more surely.
RECALL = 0.999
# Vectors that a random bucket of the largest label has on average, from which the number of bits follows.
BUCKET_VECTORS = 256
# Vectors in one block of a cell.
BLOCK_VECTORS = 512
SEED = 23


def plan_tables(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a signature and number of tables for so many vectors of one label."""
    bits = min(30, max(4, round(math.log2(max(2, vectors) / BUCKET_VECTORS))))
    alike = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - alike**bits))


def _hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).normal(size=(dim, tables * bits))


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of vectors whose largest component is 1 in size: whole numbers from -127 to 127."""
    return np.rint(x * 127).astype(np.int8)


def may_link(codes: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of codes may belong to vectors of at least this cosine; no such pair is missed.

    A component of 127 x is off its code by half at most, so a vector is off it by sqrt(dim) / 2
    and the angle between them has that over the code's length as its sine, or less.
    """
    q = codes.astype(float)
    norms = np.sqrt((q * q).sum(1))
    off = np.arcsin(np.minimum(1, np.sqrt(q.shape[1]) / 2 / norms))
    widest = np.minimum(math.pi, math.acos(cosine) + off[:, None] + off[None, :])
    return (q @ q.T) / norms[:, None] / norms[None, :] >= np.cos(widest) - 1e-9


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    recall: float = RECALL,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (it is its component's id)."""
    values = F.col("embedding").cast("array<double>")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size(values) > 0)
        & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    rows = stage(
        vectors.select("vec_id", "label", F.col("embedding").alias("vector"), sound.alias("sound")).withColumns(
            {
                "sound": F.coalesce("sound", F.lit(False)),
                "print": F.when(F.col("sound"), F.unhex(F.sha2(F.to_json(F.struct("label", "vector")), 256))),
            }
        )
    )
    # One row of each class keeps its numbers; equal numbers are the same whichever row they come from.
    distinct = stage(
        rows.where("sound")
        .groupBy("print")
        .agg(
            F.min("vec_id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
    )
    largest = distinct.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0]
    bits, tables = plan_tables(largest or 0, cosine, recall)

    @F.arrow_udf("array<int>")
    def signatures(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), tables), np.int32)
        for mine, x in _by_length(column):
            signs = (x @ _hyperplanes(x.shape[1], bits, tables) > 0).reshape(len(mine), tables, bits)
            out[mine] = signs @ (1 << np.arange(bits))
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * tables, pa.array(out.ravel()))

    @F.arrow_udf("binary")
    def codes(column: pa.Array) -> pa.Array:
        out = [b""] * len(column)
        for mine, x in _by_length(column):
            for i, code in zip(mine, encode(x), strict=True):
                out[i] = code.tobytes()
        return pa.array(out, pa.binary())

    def meet(cell: pa.Table) -> pa.Table:
        """One link for each vector of a cell that may be near another one."""
        ids, column = np.asarray(cell.column("id")), cell.column("code").combine_chunks()
        sizes = np.asarray(pc.binary_length(column))
        links = [(_NO_IDS, _NO_IDS)]
        for dim in np.unique(sizes):
            mine = np.flatnonzero(sizes == dim)
            if len(mine) > 1:
                q = np.frombuffer(b"".join(column.take(pa.array(mine)).to_pylist()), np.int8)
                linked = may_link(q.reshape(len(mine), -1), cosine)
                np.fill_diagonal(linked, False)
                hit = linked.any(1)
                links.append((ids[mine][hit], local_roots(linked[hit][:, hit], ids[mine][hit])))
        a, b = map(np.concatenate, zip(*links, strict=True))
        return pa.table({"a": a, "b": b})

    def compare(cell: pa.Table) -> pa.Table:
        """Exact links of a cell: how many each vector has, and one of them."""
        ids, label = np.asarray(cell.column("id")), np.asarray(cell.column("label"))
        copies, block = np.asarray(cell.column("copies")), np.asarray(cell.column("_block"))
        parts = [(_NO_IDS, _NO_IDS, _NO_IDS)]
        for mine, x in _by_length(cell.column("vector").combine_chunks()):
            norms = np.sqrt((x * x).sum(1))
            linked = (x @ x.T) / norms[:, None] / norms[None, :] >= cosine
            linked &= label[mine][:, None] == label[mine][None, :]
            np.fill_diagonal(linked, False)
            if cell.column("_lo")[0] != cell.column("_hi")[0]:
                linked &= block[mine][:, None] != block[mine][None, :]
            hit = linked.any(1)
            own = ids[mine][hit]
            parts.append((own, local_roots(linked[hit][:, hit], own), (linked @ copies[mine])[hit]))
        a, b, links = map(np.concatenate, zip(*parts, strict=True))
        return pa.table({"a": a, "b": b, "links": links})

    # The same vec_id may be in several classes; they share one place in the groups.
    length = F.size("vector")
    coded = stage(
        distinct.select(
            "id", "label", length.alias("dim"), signatures("vector").alias("signs"), codes("vector").alias("code")
        )
    )
    spread = coded.select("id", "label", "dim", "code", F.posexplode("signs").alias("table", "sign"))
    bucket = F.xxhash64("label", "dim", "table", "sign")  # different ones that agree only add work
    dealt = block_cells(spread.select("id", "code", bucket.alias("_bucket")), "id", block_vectors)
    near = stage(in_cells(dealt.drop("_block"), meet, "a bigint, b bigint"))
    # An id that is linked to other vectors of the same id only is a group by itself.
    place = F.coalesce("component", "id").alias("_bucket")
    group = near.select(F.col("a").alias("id")).distinct().join(components(near), "id", "left").select("id", place)
    members = stage(distinct.select("id", "label", "vector", "copies").join(group, "id"))
    dealt = block_cells(members, "id", block_vectors)
    found = stage(in_cells(dealt, compare, "a bigint, b bigint, links bigint"))
    counts = found.groupBy("a").agg(F.sum("links").alias("_links"))
    groups = components(found.select("a", "b"))
    per_class = (
        distinct.select("print", "id", "copies")
        .join(counts, F.col("id") == F.col("a"), "left")
        .drop("a")
        .join(groups, "id", "left")
        .select(
            "print",
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return rows.select("vec_id", "print").join(per_class, "print", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


_NO_IDS = np.zeros(0, np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length in double precision: their places, and they scaled to a largest size of 1."""
    flat, starts = flat_lists(column)
    sizes = np.diff(starts)
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        x = flat[starts[mine][:, None] + np.arange(dim)].astype(float)
        yield mine, x / np.abs(x).max(1, keepdims=True)  # no square is too large or too small
