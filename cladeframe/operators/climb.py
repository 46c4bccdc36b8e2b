"""Climb a parent-pointer tree by pointer doubling.

Every node carries a pointer `jump` and fields describing the stretch of chain it has
covered. One round joins each unfinished node to the node it points at, which doubles
the stretch: a chain of depth d is done after log2(d) rounds. Only nodes that are
somebody's parent take part in the rounds; all others join them once. A round writes the
rows that were open before it, those it finishes into a folder of their own, and no
finished row is ever written again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CYCLE, NO_RANK, TOP, UNKNOWN_ID, UNKNOWN_NAME, UNRESOLVED
from .joins import lookup
from .staging import Counted, counted, sized, stage, within_broadcast

# Steps of a round that joins a broadcast table: the table is sent once and met as often.
BROADCAST_STEPS = 3


def prepared(tree: DataFrame) -> DataFrame:
    """One staged row per taxid: taxid, name, parent, rank, is_parent, known.

    Of conflicting rows the smallest (parent, rank, name) wins. Ids that are only somebody's
    parent have a row too, with `known` false. One shuffle, of what each task has made distinct.
    """
    row = F.struct(
        F.coalesce("parent", F.lit(UNKNOWN_ID)).cast("bigint").alias("parent"),
        F.coalesce("rank", F.lit(NO_RANK)).alias("rank"),
        F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"),
    )
    own = tree.where(F.col("taxid").isNotNull()).select("taxid", row.alias("row"), F.lit(False).alias("is_parent"))
    none = F.lit(None).cast(own.schema["row"].dataType)
    above = own.select(F.col("row.parent").alias("taxid"), none.alias("row"), F.lit(True).alias("is_parent"))
    merged = own.unionByName(above).groupBy("taxid").agg(
        F.min("row").alias("row"), F.max("is_parent").alias("is_parent")
    )
    return stage(
        merged.select(
            "taxid", "row.name", "row.parent", "row.rank", "is_parent", F.col("row").isNotNull().alias("known")
        ),
        parts=node_parts(),
    )


def node_parts() -> dict[str, Column]:
    """The parts of a table of nodes that are counted while it is staged."""
    known, is_top = F.col("known"), F.col("taxid") == F.col("parent")
    return {
        "known": known,
        "inner": known & F.col("is_parent"),
        "open": known & F.col("is_parent") & ~is_top,
        "top": known & is_top,
        "leaf": known & ~F.col("is_parent"),
    }


class Stretch:
    """What a climb carries: each field's value for a node alone, and for two stretches in a row.

    own     name -> the node's own value.
    joined  name -> value of a stretch (columns by their names) followed by that of the node it
            points at (names with `_` in front; null where there is no such node).
    """

    def __init__(self, own: Mapping[str, Column], joined: Mapping[str, Column]):
        self.own, self.joined = dict(own), dict(joined)

    def start(self, nodes: DataFrame) -> DataFrame:
        is_top = F.col("taxid") == F.col("parent")
        return nodes.select(
            "taxid",
            F.when(~is_top, F.col("parent")).alias("jump"),
            F.when(is_top, F.col("taxid")).alias("top"),
            F.lit(None).cast("bigint").alias("gap"),
            *[value.alias(name) for name, value in self.own.items()],
        )

    def advance(self, rows: DataFrame, target: DataFrame, times: int = 1) -> DataFrame:
        """Join every row to the node it points at and take over its stretch.

        Rows without a pointer meet nothing and stay as they are.
        """
        known = counted(rows)
        reached = sized(target.select(*[F.col(c).alias(f"_{c}") for c in target.columns]), counted(target))
        missing = F.when(F.col("_taxid").isNull(), F.col("jump"))
        step = {
            "taxid": F.col("taxid"),
            "jump": F.col("_jump"),
            "top": F.coalesce("top", "_top"),
            "gap": F.coalesce("gap", missing, "_gap"),
            **self.joined,
        }
        for _ in range(times):
            met = lookup(sized(rows, known), reached, "jump", "_taxid", staged=True)
            rows = met.select(*[value.alias(name) for name, value in step.items()])
        return rows


def status_of() -> Column:
    return (
        F.when(F.col("top").isNotNull(), TOP)
        .when(F.col("gap").isNotNull(), UNRESOLVED)
        .otherwise(CYCLE)
    )


def climb(nodes: DataFrame, stretch: Stretch, laps: int = 1, covered: Column | None = None) -> DataFrame:
    """Close the tree: every known node with its fields taken from itself to the top.

    nodes    as made by `prepared`.
    laps     how many times a chain that runs into a cycle goes round it.
    covered  how many nodes a stretch has met, if the fields tell; chains in cycles then go on
             until that grows no more, and else until their length proves the laps.

    Returns taxid, the fields, `top` (the self-parent node ending the chain), `gap` (the missing
    id at which a chain breaks) and `status`: top, unresolved or cycle. Depth is not limited:
    in a forest each round finishes at least one node, so nodes left over by a round that
    finished none sit on or below a cycle.
    """
    is_parent, self_parent = F.col("is_parent") & F.col("known"), F.col("taxid") == F.col("parent")
    inner, whole = counted(nodes).parts["inner"], counted(nodes).parts["open"]
    # The first stretches hold fields of one node: no wider than its row and a few numbers more.
    widest = counted(nodes).widest_row + 24 * (4 + len(stretch.own))
    left = whole.rows
    tops = inner.rows - left
    done = [sized(stretch.start(nodes.where(is_parent & self_parent)), Counted(tops, tops * widest, widest))]
    rows = sized(stretch.start(nodes.where(is_parent & ~self_parent)), Counted(left, left * widest, widest))
    length, met = 1, None
    unfinished = F.col("jump").isNotNull()

    def target() -> DataFrame:
        whole, known = rows, counted(rows)
        for part in done:
            whole, known = whole.unionByName(part), known + counted(part)
        return sized(whole, known)

    def advance() -> None:
        """One round; the rows it finishes go to `done`."""
        nonlocal rows, left, length, met
        reached = target()
        steps = BROADCAST_STEPS if within_broadcast(reached) else 1
        new = stretch.advance(rows, reached, steps)
        extra = {} if covered is None else {"covered": F.sum(F.when(unfinished, covered))}
        staged = stage(
            new.withColumn("open", unfinished),
            parts={"open": unfinished, "done": ~unfinished},
            by="open",
            **extra,
        )
        sizes = counted(staged)
        done.append(sized(staged.where(~F.col("open")).drop("open"), sizes.parts["done"]))
        rows = sized(staged.where(F.col("open")).drop("open"), sizes.parts["open"])
        met, left = sizes.measures.get("covered"), sizes.parts["open"].rows
        length *= steps + 1

    before = -1
    while left and left != before:
        before = left
        advance()
    if left and covered is not None:
        before = -1
        while met != before:
            before = met
            advance()
    elif left:
        # The nodes that pointers reach become fewer until they are those in cycles.
        reach, before = rows.select("jump").distinct().count(), -1
        while reach != before:
            advance()
            before, reach = reach, rows.select("jump").distinct().count()
        enough = length + laps * reach
        while length < enough:
            advance()
    whole = target()
    leaves = sized(
        stretch.start(nodes.where(F.col("known") & ~F.col("is_parent"))), counted(nodes).parts["leaf"]
    )
    leaves = stage(stretch.advance(leaves, whole))
    closed = whole.unionByName(leaves).withColumn("status", status_of()).drop("jump")
    closed = sized(closed, counted(whole) + counted(leaves))
    closed._has_cycles = bool(left)
    return closed
