"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A benchmark item of m words is looked for in all windows of m words of every document; a
document of fewer words is one window of its whole text.
Items and windows are multisets of word n-grams; their similarity is the weighted Jaccard
sum of minima / sum of maxima of the n-grams' counts. An n-gram is taken together with how many
equal ones stand before it, so a multiset is a set, the similarity that set's Jaccard, and
n-grams that repeat weigh in a fingerprint as they do in the similarity.

A window can only reach the similarity with an item if enough of its n-grams are the item's; that
exact bound, taken of each pair of document and item, leaves few windows and for each
few items. Windows and items get 64-bit SimHash
fingerprints, cut into one block more than the radius: fingerprints within the radius
agree in some block, so a join on blocks finds them all among those pairs. Candidates are verified
by their exact similarity. Equal windows are searched for once.

Defined results: words are lower-case runs of letters and digits; an item of fewer than n
words is one n-gram of all its words, an item without words (null included) matches
nothing; a document shorter than the item matches it as a whole, from 0 and once, and not if
it is too short for one n-gram of the item's; a null text or doc_id matches nothing; items with equal text each match; rows that
repeat a doc_id count as one document. Empty tables give an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .selecting import named
from .words import free_name, plain_words

WORDS = 5
SIMILARITY = 0.8
# At the similarity, fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
BITS, RADIUS = 64, 19
# Rows (two numbers each) up to which the benchmark's n-grams are sent to every executor.
BROADCAST_ROWS = 1 << 21


def _ngrams(words: Column, n: int) -> Column:
    """Hashes of all runs of `n` words, in order; empty if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    if n == 1:
        return hashes
    whole = F.greatest(F.size(words) - (n - 1), F.lit(0))
    # The struct keeps the hashes from being computed anew for every position.
    return F.transform(
        F.array(hashes),
        lambda h: F.transform(
            F.slice(h, 1, whole), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])
        ),
    )[0]


def simhash(ngrams: Column) -> Column:
    """64-bit SimHash of a multiset of hashes: each bit by majority."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(
            ngrams, F.lit(0), lambda acc, x: acc + F.call_function("shiftright", x, b).bitwiseAND(F.lit(1)).cast("int")
        )
        return F.when(ones * 2 > F.size(ngrams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The fingerprint cut into radius + 1 blocks: an array of values by block."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.shiftright(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
    )


def numbered(ngrams: Column) -> Column:
    """A multiset of hashes as a set: each hashed with how many equal ones stand before it."""
    plain = F.transform(ngrams, lambda x: F.xxhash64(x, F.lit(0)))
    earlier = F.transform(
        ngrams, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(ngrams, F.lit(1), i), lambda y: y == x)))
    )
    return F.when(F.size(F.array_distinct(ngrams)) == F.size(ngrams), plain).otherwise(earlier)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes, which for numbered n-grams is the multisets' weighted one."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = WORDS,
    least: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """Matches of documents and items: doc_id, item_id, similarity (the best window's),
    start (the word it begins at, from 0) and n_windows (windows that reach the similarity)."""
    spark = docs.sparkSession
    items = stage(
        benchmark.select("item_id", plain_words(F.col("text")).alias("words"))
        .withColumn("size", F.size("words"))
        .where("size > 0 and item_id is not null")
    )
    widths = [r["n"] for r in items.select(F.least("size", F.lit(words)).alias("n")).distinct().collect()]
    found = None
    for n in sorted(widths):
        own = items.where(F.least("size", F.lit(words)) == n)
        part = _matches(docs, own, n, least, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = "doc_id bigint, item_id bigint, similarity double, start int, n_windows bigint"
        return spark.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"),
        (-F.max(F.struct("similarity", -F.col("start")))["col2"]).alias("start"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def _matches(docs: DataFrame, items: DataFrame, n: int, least: float, radius: int) -> DataFrame:
    """Windows of documents that match items whose n-grams have `n` words."""
    known = stage(
        items.select("item_id", "size", _ngrams(F.col("words"), n).alias("plain"))
        .withColumn("item_grams", numbered(F.col("plain")))
        .withColumn("item_print", simhash(F.col("item_grams")))
    )
    grams = stage(known.select("item_id", "size", F.explode(F.array_distinct("plain")).alias("gram")))
    if grams.count() <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = texts.select("doc_id", _ngrams(plain_words(F.col("text")), n).alias("grams"))
    hits = listed.select("doc_id", F.size("grams").alias("_all"), F.posexplode("grams").alias("pos", "gram")).join(grams, "gram")
    # How many n-grams of a window at least are an item's if the two reach `least`; of a document
    # with fewer than `least` times the item's, all are too few.
    inside = F.col("size") - (n - 1)
    span = F.least(inside, F.col("_all"))
    needed = F.ceil((inside + span) * (least / (1 + least)) - 1e-9).cast("int")
    met = (
        hits.where(F.col("_all") >= inside * least - 1e-9)
        .groupBy("doc_id", "_all", "item_id", "size")
        .agg(F.sort_array(F.collect_set("pos")).alias("_at"))
        .withColumns({"_span": span, "_needed": needed})
        .where(F.size("_at") >= F.col("_needed"))
    )
    # A window has enough hits if it holds one of them and the next needed - 1.
    first = F.sequence(F.lit(0), F.size("_at") - F.col("_needed"))
    held = F.transform(
        F.filter(first, lambda i: F.get("_at", i + F.col("_needed") - 1) - F.get("_at", i) < F.col("_span")),
        lambda i: F.sequence(
            F.greatest(F.get("_at", i + F.col("_needed") - 1) - F.col("_span") + 1, F.lit(0)),
            F.least(F.get("_at", i), F.col("_all") - F.col("_span")),
        ),
    )
    starts = F.array_distinct(F.flatten(held))
    wanted = stage(
        met.select("doc_id", "item_id", "size", starts.alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("item_id", "size", "starts")).alias("at"))
    )
    cut = (
        named(texts, wanted.select("doc_id"))
        .join(wanted, "doc_id")
        .select("doc_id", _ngrams(plain_words(F.col("text")), n).alias("grams"), F.explode("at").alias("at"))
        .select("doc_id", "grams", "at.item_id", "at.size", F.explode("at.starts").alias("start"))
        .withColumn("grams", F.slice("grams", F.col("start") + 1, F.col("size") - (n - 1)))
        .withColumn("c1", F.xxhash64("grams"))
        .withColumn("c2", F.xxhash64(F.lit(1), "grams"))
    )
    placed = stage(cut)
    content = ["size", "c1", "c2"]
    contents = stage(
        placed.groupBy(*content)
        .agg(F.any_value("grams").alias("grams"))
        .withColumn("grams", numbered(F.col("grams")))
        .withColumn("print", simhash(F.col("grams")))
    )
    pairs = placed.select(*content, "item_id").distinct().join(contents.select(*content, "print"), content)
    left = pairs.select(*content, "item_id", "print", F.posexplode(blocks(F.col("print"), radius)).alias("block", "value"))
    right = known.select(
        "item_id", "size", "item_print", F.posexplode(blocks(F.col("item_print"), radius)).alias("block", "value")
    )
    candidates = (
        left.join(right, ["item_id", "size", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select(*content, "item_id")
        .distinct()
    )
    verified = (
        candidates.join(contents.select(*content, "grams"), content)
        .join(known.select("item_id", "size", "item_grams"), ["item_id", "size"])
        .withColumn("similarity", similarity(F.col("grams"), F.col("item_grams")))
        .where(F.col("similarity") >= least)
        .select(*content, "item_id", "similarity")
    )
    return placed.select("doc_id", "item_id", "start", *content).distinct().join(verified, [*content, "item_id"]).select(
        "doc_id", "item_id", "similarity", "start"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    bad = free_name(docs, "_bad")
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(bad), "left_anti")
