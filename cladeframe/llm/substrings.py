"""Substring dedup over words: a count-min prefilter, then exact grouping.

A window is `window` consecutive words. Each task keeps a count-min sketch of the anchors
of its windows (see `anchors`: equal windows have equal anchors, so an anchor's estimate
never falls below the count of a window it stands for). The sketches are merged; a second
pass lets through only windows whose estimate is above one and groups those exactly.

The sketch has a fixed number of saturating cells, a documented bound on memory. On a
corpus that fills it, more windows reach the exact pass; none is ever lost.

Exact grouping first settles anchors that stand in one and the same surrounding
everywhere, and compares single windows only where surroundings differ.

Defined results: null and empty texts have no word; a document shorter than a window
loses nothing; doc_id is expected to be unique, and rows that repeat one together with its
text all lose the same; a row without doc_id loses nothing and takes nothing from others.
An empty table gives an empty result. Other columns are kept; those with the names of new
ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .anchors import anchor_places, repeated, rolled
from .samples import flat_lists
from .selecting import beside, named
from .words import free_name, word_array

WINDOW = 50
GRAM = 10
# Rows of the count-min sketch, and cells in a row. A cell counts 0, 1 or more.
ROWS = 2
CELLS = 1 << 24
# Cells that travel together while sketches are merged.
STRIPE = 1 << 18


def _gram_places(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    grams = rolled(h.view(np.uint64), gram, 1)
    places = anchor_places(grams, window - gram + 1)
    return grams, places


def _cell(grams: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((grams >> np.uint64(row * 24)) % np.uint64(cells)).astype(np.int64)


def count_min(words: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> np.ndarray:
    """The merged sketch of all anchors: ROWS x cells numbers 0, 1 or 2 (two or more).

    Every document counts an anchor once. Tasks send only the stripes they touched, in
    sparse form when that is smaller, and merge by stripe; the driver gets ROWS * cells
    numbers of two bits, whatever the corpus holds.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            flat, starts = flat_lists(batch.column(0))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                grams, places = _gram_places(flat[a:b], window, gram)
                once = np.unique(grams[places])
                for row in range(ROWS):
                    cell, n = np.unique(_cell(once, row, cells), return_counts=True)
                    own[row, cell] = np.minimum(own[row, cell] + np.minimum(n, 2), 2)
        for row in range(ROWS):
            for at in range(0, cells, STRIPE):
                part = own[row, at : at + STRIPE]
                hit = np.flatnonzero(part)
                if len(hit):
                    packed = (hit * 4 + part[hit]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {"stripe": [(row * cells + at) // STRIPE], "packed": [packed.tobytes()]}
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(packed, np.int32)
                total = stripes.setdefault(stripe, np.zeros(STRIPE, np.uint8))
                total[part // 4] = np.minimum(total[part // 4] + part % 4, 2)
        for stripe, total in stripes.items():
            bits = np.packbits(np.stack((total >= 1, total >= 2)), axis=1)
            yield pa.RecordBatch.from_pydict({"stripe": [stripe], "packed": [bits.tobytes()]})

    schema = "stripe bigint, packed binary"
    merged = np.zeros(ROWS * cells, np.uint8)
    for row in words.select("words").mapInArrow(sketch, schema).repartition("stripe").mapInArrow(merge, schema).collect():
        bits = np.unpackbits(np.frombuffer(row["packed"], np.uint8).reshape(2, -1), axis=1)
        merged[row["stripe"] * STRIPE :][:STRIPE] = bits.sum(0)
    return merged.reshape(ROWS, cells)


def _hashed_words(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    ).where("doc_id is not null")


def _candidates(words: DataFrame, sketch, window: int, gram: int) -> DataFrame:
    """Anchors that the sketch takes to be repeated, with their surroundings.

    `windows` has the hash of every window that holds the anchor; `start` is the first
    one's place. Anchors go by themselves: gram, context, doc_id, start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            flat, starts = flat_lists(batch.column(1))
            out = [[], [], [], [], []]
            for doc, a, b in zip(ids, starts[:-1], starts[1:], strict=True):
                h = flat[a:b]
                grams, places = _gram_places(h, window, gram)
                if len(places) == 0:
                    continue
                keep = np.ones(len(places), bool)
                for row in range(ROWS):
                    keep &= counts[row, _cell(grams[places], row, counts.shape[1])] > 1
                places = places[keep]
                if len(places) == 0:
                    continue
                hashes = rolled(h.view(np.uint64), window, 2)
                first = np.maximum(places - (window - gram), 0)
                last = np.minimum(places, len(hashes) - 1)
                out[0].append(grams[places].view(np.int64))
                out[1].append(_contexts(hashes, first, last).view(np.int64))
                out[2].append(np.full(len(places), doc))
                out[3].append(first)
                out[4].append(last - first + 1)
            if out[0]:
                arrays = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, t) for a, t in zip(arrays, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)],
                    ["gram", "context", "doc_id", "start", "n"],
                )

    return words.mapInArrow(run, "gram bigint, context bigint, doc_id bigint, start int, n int")


def _contexts(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash of all windows from `first` to `last`: sums of scrambled neighbours.

    The order matters through the neighbours' overlap: windows that follow each other
    share all but one word.
    """
    mixed = rolled(hashes, 1, 3)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    return rolled(running[last + 1] - running[first] + (last - first).astype(np.uint64), 1, 4)


def _open_windows(docs: DataFrame, unsettled: DataFrame, window: int) -> DataFrame:
    """The single windows of anchors in several surroundings: (window hash, doc_id, start)."""
    places = unsettled.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            flat, starts = flat_lists(batch.column(1))
            begin, places = flat_lists(batch.column(2))
            length, _ = flat_lists(batch.column(3))
            for i, doc in enumerate(ids):
                hashes = rolled(flat[starts[i] : starts[i + 1]].view(np.uint64), window, 2)
                other = rolled(flat[starts[i] : starts[i + 1]].view(np.uint64), window, 5)
                own = slice(places[i], places[i + 1])
                mark = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(mark, np.minimum(begin[own], len(hashes)), 1)
                np.add.at(mark, np.minimum(begin[own] + length[own], len(hashes)), -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[at].view(np.int64)),
                        pa.array(other[at].view(np.int64)),
                        pa.array(np.full(len(at), doc)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["h", "g", "doc_id", "start"],
                )

    places = stage(places)
    joined = _hashed_words(named(docs, places.select("doc_id"))).join(places, "doc_id")
    return joined.select("doc_id", "words", F.col("places.start"), F.col("places.n")).mapInArrow(
        run, "h bigint, g bigint, doc_id bigint, start int"
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """Runs of window starts that occur in a smaller doc_id: (doc_id, start, n)."""
    words = _hashed_words(docs)
    merged = count_min(words, window, gram, cells)
    sketch = docs.sparkSession.sparkContext.broadcast(merged)
    found = stage(repeated(stage(_candidates(words, sketch, window, gram))))
    settled = found.where("not _contexts and _first < doc_id").select("doc_id", "start", "n")
    unsettled = found.where("_contexts").select("doc_id", "start", "n")
    single = stage(_open_windows(docs, unsettled, window))
    first = single.groupBy("h", "g").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    late = single.join(first, ["h", "g"]).where("_first < doc_id")
    return settled.unionByName(late.select("doc_id", "start", F.lit(1).alias("n")))


def _cover(spans: DataFrame, name: str) -> DataFrame:
    """All spans of a document as an array called `name`; no longer than the document is."""
    return stage(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias(name)))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS
) -> DataFrame:
    """Add n_words, n_removed and `kept_text` (the kept words, joined by one space) to `docs`."""
    listed, done = free_name(docs, "_spans"), free_name(docs, "_cut")
    spans = _cover(repeated_spans(docs, window, gram, cells), listed)

    def run(words: list[str], begin, length) -> tuple[str, int]:
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, np.minimum(begin, len(words)), 1)
        np.add.at(mark, np.minimum(begin + length + window - 1, len(words)), -1)
        gone = np.cumsum(mark)[:-1] > 0
        return " ".join([w for w, g in zip(words, gone, strict=True) if not g]), int(gone.sum())

    @F.arrow_udf("struct<text: string, removed: bigint>")
    def cut(words: pa.Array, spans: pa.Array) -> pa.Array:
        texts, removed = [], []
        lists = words.to_pylist()
        flat = spans.flatten()
        begin, length = (np.asarray(flat.field(i)) for i in (0, 1))
        ends = np.concatenate(([0], np.cumsum(np.asarray(spans.value_lengths()))))
        for i, own in enumerate(lists):
            part = slice(ends[i], ends[i + 1])
            text, n = run(own, begin[part], length[part])
            texts.append(text)
            removed.append(n)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["text", "removed"])

    words = word_array(F.col("text"))
    whole = beside(docs, spans)
    none = F.array().cast("array<struct<start:int,n:int>>")
    return (
        whole.withColumn("n_words", F.size(words).cast("long"))
        .withColumn(done, F.when(F.col(listed).isNotNull(), cut(words, F.coalesce(listed, none))))
        .withColumn("n_removed", F.coalesce(f"{done}.removed", F.lit(0)).cast("long"))
        .withColumn("kept_text", F.coalesce(f"{done}.text", F.array_join(words, " ")))
        .drop(listed, done)
    )
