"""N-gram Jaccard join by chosen paths.

A document is its set of word n-grams. A chosen path samples shared tokens: with a random
function per run and path, a set of size n follows each of its tokens with chance
1 / (threshold * n), so two sets at the threshold have about one branch in common at every
level. Buckets of sets on one path are compared by brute force when they are small and
split on the next sampled token when they are not; what no token splits is compared in
cells of bounded size. Runs are repeated until the target recall, which holds for pairs
that must meet at every level too: those whose tokens all stand in many sets.

Comparison inside a bucket uses min-wise sketches, with a margin that no true pair misses
in practice; sets connected that way meet once more, with all their tokens, for the exact
similarity. That second meeting holds every pair of a connected group, so a link between
members is found even where no run brought its two sets together.

So a large bucket need not be split if its sets are connected already. The members of a large
bucket are compared with its smallest id, one comparison a member; together with the links of
small buckets that gives provisional groups. A bucket of one group, but for a block of sets, goes no
deeper: every member is compared with those. Buckets with more sets outside their largest group are
split as ever. A group of many near copies thus meets its paths of one level instead of all levels.

Defined results: a text with fewer words than n is one n-gram of all its words; a text
without words, null included, and a row without doc_id has no set: it links with nothing
and stays. Documents with equal sets are one class and link with each other. Rows that
repeat a doc_id are copies; should their texts differ, they share one set of links. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.staging import counted, derived, stage
from .components import cells, components, in_cells, local_roots
from .samples import flat_lists
from .selecting import named
from .words import word_array

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
# Levels of a path; a bucket that is still large then is compared in cells.
LEVELS = 3
# Sets in a bucket that are compared without a further split, and in a block of a cell; as many sets
# outside its largest group as a block holds does a bucket have that goes no deeper.
SMALL_BUCKET = 64
BLOCK_SETS = 512
# Tokens in a block of a cell of the exact comparison.
BLOCK_TOKENS = 1 << 19
SKETCH = 128
# Numbers that are scrambled at a time when paths are chosen.
SLAB = 1 << 14
# Standard deviations of a sketch's estimate that a true pair may lie below the threshold.
MARGIN = 5
SEED = 29


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is found with this chance.

    One run surely finds it when some path is common down to the last level, where every
    bucket is compared. At the threshold each common path has about Poisson many common
    branches, with mean 1: a path is lost within d levels with chance e^(f - 1), f being
    the chance within d - 1.
    """
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a sequence of word hashes."""
    h = hashes.view(np.uint64)
    n = min(n, len(h))
    if n == 0:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = _mix(total + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(total)


def _paths(tokens: np.ndarray, runs: int, similarity: float) -> tuple[list, list, list]:
    """All paths a set follows: level, the path before, the path."""
    bar = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(tokens)))))
    level, before, path = [], [], []
    open_paths = _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for depth in range(1, LEVELS + 1):
        children = []
        width = max(1, SLAB // len(open_paths))
        for a in range(0, len(tokens), width):
            u = _mix(open_paths[:, None] ^ tokens[a : a + width])
            at = np.flatnonzero(u < bar)
            own = open_paths[at // u.shape[1]]
            child = _mix(u.ravel()[at] + own)
            children.append(child)
            level += [depth] * len(child)
            before += own.tolist()
            path += child.tolist()
        open_paths = np.concatenate(children)
        if not len(open_paths):
            break
    return level, before, path


_SALTS = _mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sketch(tokens: np.ndarray) -> bytes:
    """One byte of each of many min-wise hashes."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for a in range(0, len(tokens), 512):
        part = tokens[a : a + 512]
        mixed = (part[None, :] ^ _SALTS[:, None]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x7FB5D329728EA185)
        least = np.minimum(least, mixed.min(1))
    return (_mix(least) & np.uint64(255)).astype(np.uint8).tobytes()


def _stars(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the members (path, id, size, sketch) of buckets with the smallest id of each, by sketch."""
    first = stage(members.groupBy("path").agg(F.min(F.struct("id", "size", "sketch")).alias("first")))
    heads = derived(first.select(F.col("path").alias("_of"), "first"), first)
    beside = lookup(members, heads, "path", "_of", "inner", staged=True).select(
        F.col("id").alias("a"),
        "size",
        "sketch",
        F.col("first.id").alias("b"),
        F.col("first.size").alias("size_b"),
        F.col("first.sketch").alias("sketch_b"),
    )
    beside = beside.where("a <> b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, size, sketch, b, size_b, sketch_b = (batch.column(i) for i in range(6))
            mine, head = (
                np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (sketch, sketch_b)
            )
            size, size_b = np.asarray(size), np.asarray(size_b)
            alike = (mine == head).sum(1) >= _sketch_bar(similarity) * SKETCH
            alike &= np.minimum(size, size_b) >= similarity * np.maximum(size, size_b)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(alike)), b.filter(pa.array(alike))], ["a", "b"])

    return stage(beside.mapInArrow(run, "a bigint, b bigint").distinct())


def _sketch_bar(similarity: float) -> float:
    """Share of equal sketch bytes from which on two sets may be similar enough."""
    return similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / SKETCH)


def _placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with the provisional group (id, component) each is in, staged."""
    known = derived(groups.withColumnRenamed("id", "_id"), groups)
    placed = lookup(members, known, "id", "_id", staged=True)
    return stage(placed.select(*members.columns, F.coalesce("component", "id").alias("group")))


def _outsiders(placed: DataFrame, most: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Settle large buckets that hold few sets outside their largest group.

    Where at most `most` sets are outside, every member is compared, by sketch, with all of those:
    with the pairs inside the group left to the exact meeting, that is every pair of the bucket. The group is
    cut into blocks of some `most` sets; a cell holds one of them and all that is outside. Returns one link
    (a, b) of each set found alike to another and the paths (as before) of buckets with more outsiders, which are split.
    """
    counts = placed.groupBy("path", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = stage(
        counts.groupBy("path").agg(
            F.max_by("group", F.struct("n", "group")).alias("main"),
            (F.sum("n") - F.max("n")).alias("out"),
            F.ceil(F.max("n") / most).cast("int").alias("blocks"),
        )
    )
    main = derived(largest.select(F.col("path").alias("_of"), "main", "out", "blocks"), largest)
    marked = lookup(placed, main, "path", "_of", "inner", staged=True).where(F.col("out").between(1, most))
    outside, block = F.col("group") != F.col("main"), F.pmod(F.xxhash64("id"), "blocks").cast("int")
    dealt = marked.select(
        "id",
        "size",
        "sketch",
        outside.alias("outside"),
        F.col("path").alias("_bucket"),
        F.explode(F.when(outside, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))).alias("_lo"),
    ).withColumn("_hi", F.col("_lo"))

    def meet(cell: pa.Table) -> pa.Table:
        ids, size = np.asarray(cell.column("id")), np.asarray(cell.column("size"))
        outside = cell.column("outside").to_numpy()
        if not outside.any():
            return _empty("a", "b")
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        linked = np.zeros((len(ids), len(ids)), bool)
        for i in np.flatnonzero(outside):
            linked[i] = (sketch == sketch[i]).sum(1) >= _sketch_bar(similarity) * SKETCH
            linked[i] &= np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i])
        linked |= linked.T
        np.fill_diagonal(linked, False)
        hit = linked.any(1)
        return pa.table({"a": ids[hit], "b": local_roots(linked[hit][:, hit], ids[hit])})

    links = stage(in_cells(dealt, meet, "a bigint, b bigint").where("a <> b").distinct())
    return links, largest.where(F.col("out") > most).select(F.col("path").alias("before"))


def _word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def _digests(docs: DataFrame, words: int, similarity: float, runs: int) -> DataFrame:
    """Per document: fingerprint and size of its set, its sketch and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = flat_lists(batch.column(1))
            prints, sizes, sketches, levels, befores, paths = [], [], [], [], [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                tokens = ngram_set(flat[a:b], words)
                if len(tokens) == 0:
                    row = None, 0, None, [], [], []
                else:
                    level, before, path = _paths(tokens, runs, similarity)
                    row = (
                        hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest(),
                        len(tokens),
                        _sketch(tokens),
                        level,
                        np.array(before, np.uint64).view(np.int64),
                        np.array(path, np.uint64).view(np.int64),
                    )
                for out, value in zip((prints, sizes, sketches, levels, befores, paths), row, strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints, pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.array(sketches, pa.binary()),
                    pa.array(levels, pa.list_(pa.int32())),
                    pa.array(befores, pa.list_(pa.int64())),
                    pa.array(paths, pa.list_(pa.int64())),
                ],
                ["doc_id", "print", "size", "sketch", "levels", "befores", "paths"],
            )

    schema = (
        "doc_id bigint, print string, size int, sketch binary, "
        "levels array<int>, befores array<bigint>, paths array<bigint>"
    )
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _word_hashes(F.col("text")).alias("words"))
    return hashed.mapInArrow(run, schema)


def _empty(*names: str) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def _across(linked: np.ndarray, cell: pa.Table) -> np.ndarray:
    """Only pairs of different blocks, in a cell of two blocks; never a row with itself."""
    np.fill_diagonal(linked, False)
    if cell.column("_lo")[0] != cell.column("_hi")[0]:
        block = np.asarray(cell.column("_block"))
        linked &= block[:, None] != block[None, :]
    return linked


def set_join(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    small_bucket: int = SMALL_BUCKET,
    block_sets: int = BLOCK_SETS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with an equal set), n_links
    (other documents at the similarity or above), component_id and kept."""
    digests = stage(_digests(docs, words, similarity, runs_for(recall)))
    classes = (
        digests.where("print is not null and doc_id is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    sets = stage(
        digests.select(F.col("doc_id").alias("id"), "print", "size", "sketch")
        .join(classes, ["print", "id"])
        .dropDuplicates(["id"])
        .select("id", "size", "copies", "sketch")
    )
    bar = _sketch_bar(similarity)

    def by_sketch(cell: pa.Table) -> pa.Table:
        ids = np.asarray(cell.column("id"))
        if len(ids) < 2:
            return _empty("a", "b")
        sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        size = np.asarray(cell.column("size"))
        alike = np.stack([(sketch == s).sum(1) for s in sketch]) >= bar * SKETCH
        alike &= np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size)
        linked = _across(alike, cell)
        hit = linked.any(1)
        return pa.table({"a": ids[hit], "b": local_roots(linked[hit][:, hit], ids[hit])})

    # Copies have the paths of the one that stands for them, so only that one walks.
    walk = F.arrays_zip("levels", "befores", "paths")
    walkers = named(digests, sets.select(F.col("id").alias("doc_id")))
    candidates, large, provisional = None, None, None
    for level in range(1, LEVELS + 1):
        step = (
            walkers.select(F.col("doc_id").alias("id"), F.explode(walk).alias("w"))
            .where(F.col("w.levels") == level)
            .select("id", F.col("w.befores").alias("before"), F.col("w.paths").alias("path"))
        )
        if large is not None:
            step = step.join(large, "before", "left_semi")
        step = stage(step.select("id", "path").distinct())
        sizes = stage(step.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
        met = sizes if level == LEVELS else sizes.where(F.col("_n") <= small_bucket)
        large = sizes.where(F.col("_n") > small_bucket).select("path")
        small = step.join(met.select("path"), "path", "left_semi").join(sets, "id")
        dealt = cells(small.select("id", "size", "sketch", "path"), F.col("path"), "id", F.lit(1), block_sets)
        pairs = stage(in_cells(dealt, by_sketch, "a bigint, b bigint").where("a <> b").distinct())
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
        if level == LEVELS or large.isEmpty():
            break
        members = stage(step.join(large, "path", "left_semi").join(sets.select("id", "size", "sketch"), "id"))
        if provisional is None:
            candidates = candidates.unionByName(_stars(members, similarity))
            provisional = stage(components(candidates))
        links, left = _outsiders(_placed(members, provisional), block_sets, similarity)
        candidates = candidates.unionByName(links)
        large = stage(left)
        if counted(large).rows == 0:
            break
    groups = stage(components(candidates))

    def exact(cell: pa.Table) -> pa.Table:
        ids = np.asarray(cell.column("id"))
        flat, starts = flat_lists(cell.column("words").combine_chunks())
        own = [ngram_set(flat[a:b], words) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        size = np.array([len(t) for t in own])
        if len(ids) < 2:
            return _empty("a", "b", "links")
        names, place = np.unique(np.concatenate(own), return_inverse=True)
        offsets = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(names), np.int32)
        common = np.zeros((len(ids), len(ids)), np.int32)
        for i in range(len(ids)):
            mine = place[offsets[i] : offsets[i + 1]]
            mark[mine] = 1
            common[i] = np.add.reduceat(mark[place], offsets[:-1])
            mark[mine] = 0
        linked = _across(common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9, cell)
        hit = linked.any(1)
        copies = np.asarray(cell.column("copies"))
        root = local_roots(linked[hit][:, hit], ids[hit])
        return pa.table({"a": ids[hit], "b": root, "links": (linked @ copies)[hit]})

    grouped = groups.join(sets.select("id", "size", "copies"), "id")
    texts = named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), groups.select(F.col("id").alias("doc_id")))
    full = grouped.join(texts.withColumnRenamed("doc_id", "id"), "id").dropDuplicates(["id"])
    dealt = cells(
        full.select("id", "copies", "size", "component", _word_hashes(F.col("text")).alias("words")),
        F.col("component"),
        "id",
        F.col("size"),
        block_tokens,
    )
    found = stage(in_cells(dealt, exact, "a bigint, b bigint, links bigint"))
    links = found.groupBy("a").agg(F.sum("links").alias("_links")).withColumnRenamed("a", "id")
    joined = components(found.select("a", "b"))
    per_class = (
        classes.join(links, "id", "left")
        .join(joined, "id", "left")
        .select(
            "print",
            F.col("id").alias("class_id"),
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return (
        digests.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
        .join(per_class, "print", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )
    )
