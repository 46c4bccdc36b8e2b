"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source gets a target number of words. Blocks of equal length are allocated to the
sources by highest quotients target / (2 a + 1), then again to the shards of each source.
A shard is a bounded number of documents in seeded order, laid end to end; its quota of
blocks is taken from the front of that order, going round again when it is used up.
DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a document of size 0 is taken 0 times; rows that repeat a doc_id are documents of
their own; an empty table gives an empty result. Other columns of the input are ignored by `mix`
and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage
from .words import word_count

# Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
# No source and no document is repeated more often than this.
MOST_REPEATS = 3
# Words in a block.
BLOCK_WORDS = 16
# Documents in a shard, on average; its rows meet in one task.
SHARD_DOCS = 4096
SEED = 17


def targets(sources: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Add `target` to sources (source, source_size), one row each.

    Targets share the sum of all sizes by weight; none exceeds `most_repeats` times its
    source, and what is cut off goes to the others by weight. With the sources in order
    of cap / weight, those before some place are at their cap and the rest get the same
    amount per weight; the first place where that amount fits is the answer.
    """
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").isNull(), "source")
    by_cap = everything.orderBy(F.col("_cap") / F.col("_weight"), "_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    choices = F.array(*[F.lit(w) for w in weights])
    return (
        sources.withColumn("_no", F.row_number().over(named) - 1)
        .withColumn("_weight", F.get(choices, F.col("_no") % len(weights)))
        .withColumn("_cap", F.col("source_size") * most_repeats)
        .withColumn("_level", rest / F.sum("_weight").over(onward))
        .withColumn("_fits", F.col("_level") * F.col("_weight") <= F.col("_cap"))
        .withColumn("_place", F.row_number().over(by_cap))
        .withColumn(
            "_level",
            F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(everything)["_level"],
        )
        .withColumn(
            "target",
            F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")),
        )
        .drop("_no", "_weight", "_cap", "_level", "_fits", "_place")
    )


def sainte_lague(parts: DataFrame, group: list[str], claim: str, seats: str, order: str) -> DataFrame:
    """Add `quota`: each group's `seats` allocated to its rows by highest quotients.

    Two divisors that enclose the right one give each row a number of seats it surely
    has and one it surely does not exceed; only the quotients in between, about two a
    row, are ranked. Ties go to the smaller `order`. No row with a claim of 0 gets a seat.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(claim).over(whole)
    slack = F.count(F.lit(1)).over(whole) / 2 + 1
    low = F.when(
        (F.col(seats) > slack) & (total > 0),
        F.ceil(F.col(claim) * (F.col(seats) - slack) / total - 0.5),
    ).otherwise(F.lit(0))
    high = F.when(total > 0, F.floor(F.col(claim) * (F.col(seats) + slack) / total + 0.5) + 1)
    bounded = (
        parts.withColumn("_low", F.greatest(low, F.lit(0)).cast("long"))
        .withColumn("_high", F.coalesce(high, F.lit(0)).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    )
    ranked = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), order, "_seat")
    won = (
        bounded.where((F.col(claim) > 0) & (F.col("_high") > F.col("_low")))
        .withColumn("_seat", F.explode(F.sequence("_low", F.col("_high") - 1)))
        .withColumn("_quotient", F.col(claim) / (F.col("_seat") * 2 + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, order)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    keys = list(dict.fromkeys([*group, order]))
    return (
        bounded.join(won, keys, "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_low", "_high", "_open", "_won")
    )


def _source_key(source: Column) -> Column:
    """A key that is never null: sources are prefixed, null is empty."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: int = SEED,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, source, size, source_size, target (the source's) and taken (words,
    repeats counted), and the columns of the input in `also`, one row per input row.
    """
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stage(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            _source_key(F.col("source")).alias("_source"),
            ticket.alias("_ticket"),
            *also,
        )
    )
    totals = sized.groupBy("_source").agg(
        F.max("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("_docs"),
    )
    claims = targets(totals, weights, most_repeats).withColumn(
        "_blocks",
        F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"),
    )
    quotas = stage(
        sainte_lague(claims.withColumn("_all", F.lit(0)), ["_all"], "target", "_blocks", "_source")
        .withColumn("_shards", F.ceil(F.col("_docs") / shard_docs).cast("long"))
        .select("_source", "source_size", "target", F.col("quota").alias("_seats"), "_shards")
    )
    placed = sized.join(quotas, "_source").withColumn(
        "_shard", F.conv(F.substring("_ticket", 1, 12), 16, 10).cast("long") % F.col("_shards")
    )
    shards = (
        placed.groupBy("_source", "_shard")
        .agg(F.sum("size").alias("_words"), F.first("_seats").alias("_seats"))
        .withColumn("_claim", F.col("_words").cast("double"))
    )
    shares = sainte_lague(shards, ["_source"], "_claim", "_seats", "_shard").select(
        "_source",
        "_shard",
        "_words",
        F.least(F.col("quota") * block_words, F.col("_words") * most_repeats).alias("_quota"),
    )
    in_order = Window.partitionBy("_source", "_shard").orderBy("_ticket", "doc_id", "size")
    start = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rounds = F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(F.lit(0))
    return (
        placed.join(shares, ["_source", "_shard"])
        .withColumn("_start", start)
        .withColumn("_rounds", rounds.cast("long"))
        .withColumn("_rest", F.col("_quota") - F.col("_rounds") * F.col("_words"))
        .withColumn(
            "taken",
            F.col("_rounds") * F.col("size")
            + F.greatest(
                F.lit(0).cast("long"),
                F.least(F.col("_start") + F.col("size"), F.col("_rest")) - F.col("_start"),
            ),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken", *also)
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows the mix takes words of, with all their columns, size, source_size, target and taken.

    Rows are numbered in a written table and known by that number, so that a row without a
    doc_id stays and rows that share one meet only what was taken of each. A column of the
    input with the name of a new one is replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    old = [c for c in docs.columns if c not in new]
    rows = stage(docs.select(*old).withColumn("_row", F.monotonically_increasing_id()))
    taken = mix(rows, **options, also=("_row",)).where("taken > 0").select("_row", *new)
    return rows.join(taken, "_row").select(*old, *new)
