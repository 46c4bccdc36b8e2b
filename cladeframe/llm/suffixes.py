"""Suffix-array dedup over bytes.

Every byte that a `window`-byte string covers which also starts earlier - in a smaller
doc_id, or before in the same document - is removed.

Not every suffix need be sorted: each window holds an anchor (see `anchors`), so suffixes
that begin at repeated anchors show every repeat; the bytes on both sides of an anchor that
its windows reach are its context. Where all occurrences of an anchor have one context,
all but the first are settled. The suffixes of the others are dealt by range, at splitters
that Spark samples, by their leading bytes; each range is sorted by multikey quicksort,
and longest common prefixes to the right and to the left of the anchors tell which windows
are equal. Suffixes of one anchor stay in one range, but for anchors in very many contexts:
theirs are dealt by all their bytes, and what is first in its range is compared across
boundaries, window by window.

Defined results: texts are taken as UTF-8, null as empty; a document shorter than a window
loses nothing; doc_id is expected to be unique, and rows that repeat one must repeat the
text; a row without doc_id loses nothing and takes nothing from others. An empty table
gives an empty result. Other columns stay; those with the names of new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.repeats import may_repeat
from ..operators.staging import stage
from .anchors import anchor_places, repeated, rolled, scramble
from .samples import flat_bytes, flat_lists
from .selecting import beside, named, unnamed
from .words import free_name

WINDOW = 100
GRAM = 32
# An anchor in more contexts than this has several ranges.
RANGE_ROWS = 1 << 14
# Below this many rows a range is sorted by all its keys at once.
SMALL_SORT = 64


def _context(grams: np.ndarray, places: np.ndarray, size: int, window: int, gram: int):
    """Hash of all bytes that windows with the anchor reach, and how far they reach."""
    left = np.minimum(places, window - gram)
    right = np.minimum(window, size - places)
    total = scramble((left * 1009 + right).astype(np.uint64))
    steps = [*range(-(window - gram), 0, gram), -gram, *range(0, window - gram, gram), window - gram]
    for i, step in enumerate(steps):
        at = np.clip(places + step, places - left, places + right - gram)
        total = scramble(total + grams[at] + np.uint64(i))
    return total, left, right


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors of each text; `again` if the same one in the same context came before in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            flat, starts = flat_bytes(batch.column(1))
            out: list[list] = [[] for _ in range(7)]
            for doc, a, b in zip(ids, starts[:-1], starts[1:], strict=True):
                if b - a < window:
                    continue
                grams = rolled(flat[a:b], gram, 1)
                places = anchor_places(grams, window - gram + 1)
                context, left, right = _context(grams, places, b - a, window, gram)
                key = grams[places]
                order = np.lexsort((places, context, key))
                same = (key[order][1:] == key[order][:-1]) & (context[order][1:] == context[order][:-1])
                again = np.zeros(len(places), bool)
                again[order[1:][same]] = True
                row = (key.view(np.int64), context.view(np.int64), np.full(len(places), doc), places, left, right, again)
                for target, value in zip(out, row, strict=True):
                    target.append(value)
            if out[0]:
                kinds = (pa.int64(),) * 3 + (pa.int32(),) * 3 + (pa.bool_(),)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v), t) for v, t in zip(out, kinds, strict=True)],
                    ["gram", "context", "doc_id", "place", "left", "right", "again"],
                )

    schema = "gram bigint, context bigint, doc_id bigint, place int, left int, right int, again boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _suffixes(docs: DataFrame, firsts: DataFrame, window: int, gram: int) -> DataFrame:
    """The bytes after and, reversed, before each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            flat, starts = flat_bytes(batch.column(1))
            places, edges = flat_lists(batch.column(2))
            wide, _ = flat_lists(batch.column(3))
            doc = np.repeat(np.arange(len(ids)), np.diff(edges))
            for lo in range(0, len(places), 20_000):
                part = slice(lo, lo + 20_000)
                begin, end, at = starts[doc[part]], starts[doc[part] + 1], starts[doc[part]] + places[part]
                right = [flat[p : min(p + window, e)].tobytes() for p, e in zip(at, end, strict=True)]
                left = [flat[max(p - window + gram, s) : p][::-1].tobytes() for p, s in zip(at, begin, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(right, pa.binary()),
                        pa.array(left, pa.binary()),
                        pa.array(ids[doc[part]]),
                        pa.array(places[part].astype(np.int32)),
                        pa.array(wide[part].astype(bool)),
                    ],
                    ["right", "left", "doc_id", "place", "wide"],
                )

    wanted = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("place", "wide")).alias("at"))
    wanted = stage(wanted)
    joined = named(docs, wanted.select("doc_id")).join(wanted, "doc_id")
    rows = joined.select("doc_id", "text", "at.place", F.col("at.wide").cast("array<int>").alias("wide"))
    return rows.mapInArrow(run, "right binary, left binary, doc_id bigint, place int, wide boolean")


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    width = (width + 7) // 8 * 8
    flat = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(flat, np.uint8).reshape(len(values), width), np.array([len(v) for v in values])


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows: three-way partition on one 8-byte key, ties go on to the next key."""
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    todo = [(0, len(rows), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == keys.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= SMALL_SORT:
            order[lo:hi] = own[np.lexsort(keys[own, depth:].T[::-1])]
            continue
        key = keys[own, depth]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate((own[less], own[same], own[more]))
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row in order with the one before."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 50_000):
        b = min(len(order), a + 50_000)
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _late(right, left, doc, place, window: int, gram: int) -> np.ndarray:
    """For each row, by how far a window begins before the anchor: is it later than another?

    One empty column on each side; windows that a row does not have are False.
    """
    after, n_after = _padded(right, window)
    before, n_before = _padded(left, window - gram)
    by_after, by_before = multikey_quicksort(after), multikey_quicksort(before)
    common_after, common_before = _common(after, by_after), _common(before, by_before)
    earliest = np.lexsort((place, doc))
    n = len(right)
    late = np.zeros((n, window - gram + 3), bool)  # by how far the window begins before the anchor
    for back in range(window - gram + 1):
        key = np.empty(n, np.int64)
        key[by_after] = np.cumsum(common_after < window - back) * (n + 1)
        side = np.empty(n, np.int64)
        side[by_before] = np.cumsum(common_before < back)
        whole = (n_after >= window - back) & (n_before >= back)
        rows = earliest[whole[earliest]]
        first = np.unique((key + side)[rows], return_index=True)[1]
        late[rows, back + 1] = True
        late[rows[first], back + 1] = False
    return late


def _runs(late: np.ndarray, place: np.ndarray):
    """Runs of late windows: (row, first start, count)."""
    change = np.diff(late.astype(np.int8), axis=1)
    row, low = np.nonzero(change == 1)
    high = np.nonzero(change == -1)[1]
    return row, place[row] - (high - 1), high - low


def _first_windows(right, left, doc, place, late, window: int):
    """Windows that are not late among their range's, hashed: (h, g, doc_id, start)."""
    out: list[list] = [[], [], [], []]
    for r, lf, d, p, gone in zip(right, left, doc, place, late, strict=True):
        context = np.frombuffer(lf[::-1] + r, np.uint8)
        h, g = rolled(context, window, 2), rolled(context, window, 5)
        open_ = np.flatnonzero(~gone[1:-1][len(lf) - np.arange(len(h))])
        out[0].append(h[open_].view(np.int64))
        out[1].append(g[open_].view(np.int64))
        out[2].append(np.full(len(open_), d))
        out[3].append(p - len(lf) + open_)
    return [np.concatenate(x) for x in out]


def _compared(ranged: DataFrame, window: int, gram: int, border: bool) -> DataFrame:
    """Late windows of each range; with `border` also the windows that are first in it."""
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = ["border", "h", "g", "doc_id", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        right, left = (table.column(c).to_pylist() for c in ("right", "left"))
        doc, place = (np.asarray(table.column(c)) for c in ("doc_id", "place"))
        late = _late(right, left, doc, place, window, gram)
        row, start, n = _runs(late, place)
        zero = np.zeros(len(row), np.int64)
        values = (zero > 0, zero, zero, doc[row], start, n)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)
        for a in range(0, len(right) if border else 0, 2_000):
            own = slice(a, a + 2_000)
            h, g, d, s = _first_windows(right[own], left[own], doc[own], place[own], late[own], window)
            values = (np.ones(len(h), bool), h, g, d, s, np.ones(len(h), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    rows = ranged.select("right", "left", "doc_id", "place")
    return rows.mapInArrow(run, "border boolean, h bigint, g bigint, doc_id bigint, start int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of window starts that occur earlier: (doc_id, start, n), n windows from start."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= window)
    )
    prints = stage(
        texts.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"),
                     F.octet_length("text").alias("size"))
    )
    earliest = prints.groupBy("h", "g", "size").agg(F.min("doc_id").alias("first"))
    judged = prints.join(earliest, ["h", "g", "size"])
    copies = stage(
        judged.where("first < doc_id").select(
            "doc_id", F.lit(0).alias("start"), (F.col("size") - window + 1).alias("n")
        )
    )
    originals = unnamed(texts, copies.select("doc_id"))
    anchors = stage(_anchors(originals, window, gram))

    def reach(rows: DataFrame) -> DataFrame:
        return rows.select(
            "doc_id",
            (F.col("place") - F.col("left")).alias("start"),
            (F.col("left") + F.col("right") - window + 1).alias("n"),
        )

    # Most anchors stand once; only those that may repeat are shuffled.
    found = stage(repeated(may_repeat(anchors.where("not again"), "gram")))
    settled = found.where("not _contexts and _first < doc_id")
    open_ = found.where("_contexts")
    firsts = open_.groupBy("gram", "context").agg(
        F.min("doc_id").alias("_doc"), F.min_by("place", "doc_id").alias("_place")
    )
    firsts = stage(firsts)
    later = open_.join(firsts, ["gram", "context"]).where("doc_id > _doc")
    many = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RANGE_ROWS)
    places = firsts.join(many, "gram", "left").select(
        F.col("_doc").alias("doc_id"), F.col("_place").alias("place"), F.col("_n").isNotNull().alias("wide")
    )
    suffixes = stage(_suffixes(texts, stage(places), window, gram))
    narrow = suffixes.where("not wide").repartitionByRange(F.substring("right", 1, gram))
    wide = suffixes.where("wide").repartitionByRange("right", "doc_id", "place")
    compared = stage(
        _compared(narrow, window, gram, False).unionByName(_compared(wide, window, gram, True))
    )
    border = compared.where("border").groupBy("h", "g", "doc_id", "start").agg(F.max("n").alias("n"))
    earliest = (
        border.groupBy("h", "g", "doc_id")
        .agg(F.min("start").alias("start"))
        .groupBy("h", "g")
        .agg(F.min("doc_id").alias("_doc"), F.min_by("start", "doc_id").alias("_start"), F.count(F.lit(1)).alias("_n"))
    )
    crossing = border.join(earliest, ["h", "g"]).where("doc_id > _doc or start > _start").select("doc_id", "start", "n")
    return (
        copies.unionByName(reach(anchors.where("again")))
        .unionByName(reach(settled))
        .unionByName(reach(later))
        .unionByName(compared.where("not border").select("doc_id", "start", "n"))
        .unionByName(crossing)
    )


def dedup_bytes(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, whole_characters: bool = False
) -> DataFrame:
    """Add n_bytes, n_removed, n_spans (maximal removed runs) and `kept` (the bytes left).

    With `whole_characters` a character goes if any of its bytes does, so that what is left is text.
    """
    listed, done = free_name(docs, "_spans"), free_name(docs, "_cut")
    spans = stage(
        repeated_windows(docs, window, gram)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "n")).alias(listed))
    )

    @F.arrow_udf("struct<kept: binary, removed: bigint, spans: bigint>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        flat, starts = flat_bytes(text)
        parts = spans.flatten()
        begin, n = (np.asarray(parts.field(i)) for i in (0, 1))
        edges = np.concatenate(([0], np.cumsum(np.asarray(spans.value_lengths()))))
        kept, removed, runs = [], [], []
        for i in range(len(text)):
            own, part = flat[starts[i] : starts[i + 1]], slice(edges[i], edges[i + 1])
            mark = np.zeros(len(own) + 1, np.int64)
            np.add.at(mark, np.minimum(begin[part], len(own)), 1)
            np.add.at(mark, np.minimum(begin[part] + n[part] + window - 1, len(own)), -1)
            gone = np.cumsum(mark)[:-1] > 0
            if whole_characters and gone.any():
                begins = (own & 0xC0) != 0x80
                begins[0] = True
                gone = np.logical_or.reduceat(gone, np.flatnonzero(begins))[np.cumsum(begins) - 1]
            kept.append(own[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
        arrays = [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
        return pa.StructArray.from_arrays(arrays, ["kept", "removed", "spans"])

    whole = beside(docs, spans)
    none = F.array().cast("array<struct<start:int,n:int>>")
    return (
        whole.withColumn(done, F.when(F.col(listed).isNotNull(), cut("text", F.coalesce(listed, none))))
        .withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(f"{done}.removed", F.lit(0)).cast("long"))
        .withColumn("n_spans", F.coalesce(f"{done}.spans", F.lit(0)).cast("long"))
        .withColumn("kept", F.coalesce(f"{done}.kept", F.coalesce("text", F.lit("")).cast("binary")))
        .drop(listed, done)
    )
