"""Joins and per-key limits that hold up when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import counted, derived, stage, threshold, within_broadcast

# A key that has fewer rows than this is harmless in one task, whatever its share.
HOT_ROWS = 1_000_000
# A key is hot when it alone has more than one part in so many of a mean shuffle partition.
HOT_PARTS = 4
# Most items a sketch can hold.
MOST_ITEMS = 1_000_000


def hot_keys(df: DataFrame, key: str) -> list:
    """All keys of `df` heavy enough to unbalance a shuffle.

    The bar follows the rows of a mean shuffle partition, so no more than HOT_PARTS times
    the number of partitions can be above it, and the sketch is made for that many. One
    mergeable sketch per task and no shuffle of rows. Which keys come back only decides
    how a row is joined, never what it is joined to.
    """
    most = HOT_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = min(MOST_ITEMS, max(4096, 16 * most))
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {min(most, items)}, {items})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    row = found.first()
    bar = max(HOT_ROWS, row["n"] / most)
    return [item["item"] for item in (row["top"] or []) if item["count"] > bar]


def has_hot_key(facts: DataFrame, key: str) -> bool:
    """Does a key of staged `facts`, null aside, have too many rows for a task?"""
    known = counted(facts)
    return not (known is not None and known.rows <= HOT_ROWS) and bool(hot_keys(facts, key))


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    facts_key: str,
    dim_key: str,
    how: str = "left",
    staged: bool = False,
) -> DataFrame:
    """Join `facts` to `dim`, which has one row per `dim_key`.

    `how` is 'left' or 'inner'. Column names of the two sides must differ.
    A `dim` of proven small size is broadcast. Otherwise rows with a hot key meet
    those keys' rows apart from the rest, which are shuffled. `staged` says that
    `facts` is cheap to read twice; else it is staged first.
    """
    on = F.col(facts_key) == F.col(dim_key)
    if within_broadcast(dim):
        return facts.join(F.broadcast(dim), on, how)
    if not staged:
        facts = stage(facts)
    known = counted(facts)
    if known is not None and known.rows <= HOT_ROWS:
        # So few rows that no key, null included, is too many for a task: no sketch, no split.
        return facts.join(dim.hint("merge"), on, how)
    return split_join(facts, dim, facts_key, dim_key, how, hot_keys(facts, facts_key))


def spread_lookup(facts: DataFrame, dim: DataFrame, facts_key: str, dim_key: str) -> DataFrame:
    """Left join to `dim`, one row per `dim_key`, for facts proven to have no hot key, nulls aside.

    One shuffle; rows without a key meet nothing and are dealt by all they hold, so neither side is written
    or read again.
    """
    place = F.coalesce(F.col(facts_key), F.xxhash64(*facts.columns))
    return facts.join(dim.hint("merge"), (place == F.col(dim_key)) & F.col(facts_key).isNotNull(), "left")


def split_join(
    facts: DataFrame, dim: DataFrame, facts_key: str, dim_key: str, how: str, hot: list
) -> DataFrame:
    """The same join in parts: null keys alone, `hot` keys, and the rest by a shuffle.

    There are at most HOT_PARTS hot keys a shuffle partition, so the list of them is a broadcast
    table. The rows of hot keys are one per key; they are broadcast if their number times the
    widest row of `dim` is within the limit, and else repeated for every salt, so that
    a hot key is dealt to many tasks.
    """
    spark = facts.sparkSession
    on = F.col(facts_key) == F.col(dim_key)
    filled = facts.where(F.col(facts_key).isNotNull())
    if hot:
        kind = facts.schema[facts_key].dataType.simpleString()
        listed = F.broadcast(spark.createDataFrame([(key,) for key in hot], f"_hot {kind}"))
        is_hot = F.col(facts_key) == F.col("_hot")
        rest = filled.join(listed, is_hot, "left_anti").join(dim.hint("merge"), on, how)
    else:
        rest = filled.join(dim.hint("merge"), on, how)
    if how == "left":
        none = dim.where(F.lit(False))
        rest = rest.unionByName(facts.where(F.col(facts_key).isNull()).join(F.broadcast(none), on, how))
    if not hot:
        return rest
    own = filled.join(listed, is_hot, "left_semi")
    served = dim.join(listed, F.col(dim_key) == F.col("_hot"), "left_semi")
    known = counted(dim)
    if known is not None and known.widest_row * len(hot) <= threshold(spark):
        return rest.unionByName(own.join(F.broadcast(served), on, how))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = own.withColumn("_salt", F.pmod(F.xxhash64(*own.columns), F.lit(salts)).cast("int"))
    repeated = served.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = salted.join(repeated.hint("merge"), on & (F.col("_salt") == F.col("_of_salt")), how)
    return rest.unionByName(both.drop("_salt", "_of_salt"))


def narrow(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop rows of `table` without a partner in `keys`, where that needs no shuffle.

    Only ever a saving ahead of a join on the same key: the result may still hold
    other rows when `keys` is too large to broadcast.
    """
    wanted = derived(keys.select(key), keys)
    if within_broadcast(wanted):
        return table.join(F.broadcast(wanted), key, "left_semi")
    return table


def attach(keys: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of two staged tables that both have one row per `key`; no key is hot."""
    if within_broadcast(dim):
        return keys.join(F.broadcast(dim), key, "left")
    return keys.join(narrow(dim, keys, key), key, "left")


def first_k(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The `k` smallest `order` values of each `key`, as rows (key, order).

    `order` is unique within a key.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if k == 1:
        return df.groupBy(key).agg(F.min(order).alias(order))
    # Spark cuts every task's rows of a key down to k before it shuffles them.
    first = Window.partitionBy(key).orderBy(order)
    return (
        df.select(key, order)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= k)
        .select(key, order)
    )
