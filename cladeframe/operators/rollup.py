"""Roll hit counts up from accessions through the rank ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladder
from ..schemas import LEVELS, NO_RANK, RANKS, UNKNOWN_NAME
from .joins import attach
from .lineage import Taxonomy, as_taxonomy
from .staging import derived, stage


def taxid_tally(resolved: DataFrame) -> DataFrame:
    """Hits and accessions per taxid: taxid, tally, n_children.

    Summed inside each task first, so the bucket of unmapped accessions is one row
    per task by the time it is shuffled.
    """
    return resolved.groupBy("taxid").agg(
        F.sum("freq").alias("tally"), F.count(F.lit(1)).alias("n_children")
    )


def _wide(resolved: DataFrame, tree: Taxonomy) -> DataFrame:
    """One staged row per taxid hit: id_0, tally, n_children, and what was found at every rank."""
    tally = stage(taxid_tally(resolved))
    found = attach(tally, tree.answers(RANKS, ladder.CASCADE), "taxid")
    above = [F.col(f"found_{k}") for k in range(1, len(RANKS) + 1)]
    return stage(found.select(F.col("taxid").alias("id_0"), "tally", "n_children", *above, "top"))


def _levels(wide: DataFrame) -> list[DataFrame]:
    """The rollup's levels from the lowest: id_<k>, tally, n_children, found_<k + 1>.., top.

    Each is made of the one below: what lies above an answer depends on the answer only, so
    one group per answer carries it on. A level that is needed twice is shuffled once.
    """
    levels, last = [wide], len(RANKS)
    for k in range(1, last + 1):
        below = levels[-1].withColumn(f"id_{k}", ladder.answer_id(k))
        above = [f"found_{j}" for j in range(k + 1, last + 1)]
        # Whether the id was found or stands in for a missing answer is the same for all its rows.
        levels.append(
            below.groupBy(f"id_{k}").agg(
                F.sum("tally").alias("tally"),
                F.count(F.lit(1)).alias("n_children"),
                *[F.max(c).alias(c) for c in (f"found_{k}", *above, "top")],
            )
        )
    return levels


def rank_rollup(resolved: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Tallies at every level of the ladder.

    resolved: acc_ver, freq, taxid. Returns rank_level, taxid, parent_taxid,
    rank_name, mapped_rank (accession level only), tally, n_children. Each level's
    tallies add up to the number of accepted hits.
    """
    tree = as_taxonomy(tree)
    levels = _levels(_wide(resolved, tree))
    out = None
    for k, level in enumerate(levels):
        parent = ladder.answer_id(k + 1) if k < len(RANKS) else F.lit(None).cast("bigint")
        if k == 0:
            nodes = derived(
                tree.nodes.select(
                    F.col("taxid").alias("id_0"), F.col("name").alias("_name"), F.col("rank").alias("_rank")
                ),
                tree.nodes,
            )
            label, mapped = F.coalesce("_name", F.lit(UNKNOWN_NAME)), F.coalesce("_rank", F.lit(NO_RANK))
        else:
            own = tree.names(RANKS)[k]
            nodes = derived(own.select(F.col("_id").alias(f"id_{k}"), F.col("_name").alias(f"name_{k}")), own)
            label, mapped = ladder.answer_label(k), F.lit(None).cast("string")
        # A level has one row per id, by which it is dealt already; ids that stand in for a missing answer use no name.
        named = attach(level, nodes, f"id_{k}")
        rows = named.select(
            F.lit(LEVELS[k]).alias("rank_level"),
            F.col(f"id_{k}").alias("taxid"),
            parent.alias("parent_taxid"),
            label.alias("rank_name"),
            mapped.alias("mapped_rank"),
            "tally",
            "n_children",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def rollup_children(resolved: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Members of every rollup node, one row each: rank_level, taxid, child.

    A child is an accession at the lowest level and a taxid above. The long form is
    the result on purpose: the list of unmapped accessions alone may be huge.
    """
    resolved = stage(resolved)
    lowest = resolved.select(
        F.lit(LEVELS[0]).alias("rank_level"), "taxid", F.col("acc_ver").alias("child")
    )
    levels = _levels(_wide(resolved, as_taxonomy(tree)))
    for k, level in enumerate(levels[:-1]):
        lowest = lowest.unionByName(
            level.select(
                F.lit(RANKS[k]).alias("rank_level"),
                ladder.answer_id(k + 1).alias("taxid"),
                F.col(f"id_{k}").cast("string").alias("child"),
            )
        )
    return lowest
