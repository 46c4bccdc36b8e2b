"""Nested intervals over a tree: a subtree is a range of numbers.

Every node gets an entry number such that its descendants are those numbered from entry + 1
to entry + size - 1. Sizes come from pointer doubling: after r rounds a node knows how many nodes
lie less than 2^r levels below it, and adds what those exactly 2^r levels below know. A node's entry is
the sum, along its chain, of the sizes of earlier siblings; that sum is taken by a climb. Tops and
missing parents are siblings of each other, so numbers are unique in the whole forest. Nodes on or
below a cycle have no number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CYCLE
from .climb import Stretch, climb, node_parts
from .joins import lookup
from .staging import counted, sized, stage

# Numbers that one row is spread into at a time when a range is written out.
CHUNK = 1 << 16


def _sizes(nodes: DataFrame) -> DataFrame:
    """Nodes that are parents, missing ones included: taxid, size. Meaningless in cycles."""
    leaf = F.col("known") & ~F.col("is_parent")
    below = nodes.where(leaf).groupBy(F.col("parent").alias("_up")).agg(F.count(F.lit(1)).alias("_leaves"))
    step_up = F.when(F.col("known") & (F.col("taxid") != F.col("parent")), F.col("parent"))
    inner = nodes.where("is_parent").select("taxid", step_up.alias("jump"))
    unfinished = F.count_if(F.col("jump").isNotNull())
    state = stage(
        inner.join(below, F.col("taxid") == F.col("_up"), "left").select(
            "taxid", "jump", (1 + F.coalesce("_leaves", F.lit(0))).cast("long").alias("size")
        ),
        left=unfinished,
    )
    before = -1
    while (left := counted(state).measures["left"]) not in (0, before):
        before = left
        known = counted(state)
        sums = state.where("jump is not null").groupBy(F.col("jump").alias("_of")).agg(F.sum("size").alias("_sum"))
        ahead = sized(state.select(F.col("taxid").alias("_at"), F.col("jump").alias("_next")), known)
        grown = sized(lookup(state, sized(sums, known), "taxid", "_of", staged=True), known)
        # No key of the first join is hot: both sides have one row per taxid.
        moved = lookup(grown, ahead, "jump", "_at", staged=True)
        state = stage(
            moved.select(
                "taxid", F.col("_next").alias("jump"), (F.col("size") + F.coalesce("_sum", F.lit(0))).alias("size")
            ),
            left=unfinished,
        )
    return state.select("taxid", "size")


def _offsets(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """nodes with size and offset: numbers from the parent's entry to the node's own.

    Siblings are summed in blocks of their hash and the blocks' sums then in order, so a parent
    with very many children is no single task's.
    """
    blocks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step_up = F.col("known") & (F.col("taxid") != F.col("parent"))
    named = sizes.select(F.col("taxid").alias("_of"), "size")
    sized_nodes = nodes.join(named, F.col("taxid") == F.col("_of"), "left").select(
        "taxid",
        # A missing parent stands as a top of its own here.
        F.when(F.col("known"), F.col("parent")).otherwise(F.col("taxid")).alias("parent"),
        "is_parent",
        F.coalesce("size", F.lit(1)).cast("long").alias("size"),
        (~step_up).alias("_first"),
        F.when(step_up, F.col("parent")).otherwise(0).alias("_up"),
        F.pmod(F.xxhash64("taxid"), F.lit(blocks)).cast("int").alias("_block"),
    )
    family = ["_first", "_up"]
    earlier = Window.partitionBy(*family, "_block").orderBy("taxid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized_nodes.withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    ahead = Window.partitionBy(*family).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sized_nodes.groupBy(*family, "_block")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        .drop("_sum")
    )
    own = F.when(F.col("_first"), 0).otherwise(1)
    return placed.join(sums, [*family, "_block"]).select(
        "taxid",
        "parent",
        "is_parent",
        F.lit(True).alias("known"),
        "size",
        (F.col("_before") + F.col("_ahead") + own).cast("long").alias("offset"),
    )


def number(nodes: DataFrame) -> DataFrame:
    """Numbered nodes, as `prepared` made them: taxid, entry, size; missing parents included."""
    numbered = stage(_offsets(nodes, _sizes(nodes)), parts=node_parts())
    along = Stretch(
        {"size": F.col("size"), "entry": F.col("offset")},
        {"size": F.col("size"), "entry": F.col("entry") + F.coalesce("_entry", F.lit(0))},
    )
    closed = climb(numbered, along)
    found = sized(closed.where(F.col("status") != CYCLE).select("taxid", "entry", "size"), counted(closed))
    found._has_cycles = closed._has_cycles
    return found


def spread(ranges: DataFrame, first: str, size: str, name: str) -> DataFrame:
    """A row for every number from `first` on, `size` of them, as `name`, beside the other columns.

    A long range is cut into chunks that are dealt out before they are written out.
    """
    others = [c for c in ranges.columns if c not in (first, size)]
    chunks = ranges.where(F.col(size) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(size) - 1), F.lit(CHUNK).cast("long")))
    )
    dealt = chunks.repartition(*others, "_chunk")
    last = F.least(F.col("_chunk") + CHUNK, F.col(size)) - 1
    return dealt.select(
        *others, F.explode(F.sequence(F.col(first) + F.col("_chunk"), F.col(first) + last)).alias(name)
    )
