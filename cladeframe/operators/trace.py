"""The wide lineage table: one row per taxid, one id and name per reported rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladder
from ..schemas import NO_RANK, RANK_FOLDER, RANK_MARK, RANKS
from .joins import lookup
from .lineage import Taxonomy, as_taxonomy, with_names
from .staging import derived, stage


def distinct_taxids(acc_map: DataFrame) -> DataFrame:
    """The taxids that occur in an accession map."""
    return acc_map.select("taxid").where(F.col("taxid").isNotNull()).distinct()


def accessions_per_taxid(acc_map: DataFrame) -> DataFrame:
    """Rows of an accession map per taxid: taxid, count."""
    return acc_map.groupBy("taxid").agg(F.count(F.lit(1)).alias("count"))


def seed_join(seeds: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Tree nodes of the distinct seeds: taxid, name, parent, rank."""
    nodes = as_taxonomy(tree).nodes.select("taxid", "name", "parent", "rank")
    return nodes.join(seeds.select("taxid").distinct(), "taxid")


def trace_table(
    seeds: DataFrame,
    tree: DataFrame | Taxonomy,
    mode: str = ladder.CASCADE,
    ranks: Sequence[str] = RANKS,
) -> DataFrame:
    """taxid, name, parent, rank, then <rank>_taxid and <rank>_name per rank.

    `cascade` looks each rank up from the previous rank's answer, `direct` from the
    seed. Names are the tree's own; the top of the chain stands in where a rank is
    missing, and (-1, unknown) where the chain is broken. Both sides of the join
    are staged, so Spark broadcasts either if it is small, and have unique keys, so
    no key is hot if neither is.
    """
    tree = as_taxonomy(tree)
    ranks = list(ranks)
    wanted = stage(seeds.select("taxid").where(F.col("taxid").isNotNull()).distinct())
    nodes = tree.nodes.select("taxid", "name", "parent", "rank")
    found = wanted.join(nodes, "taxid").join(tree.answers(ranks, mode), "taxid")
    found = with_names(found, tree, ranks, range(len(ranks) + 1))
    columns = [F.col(c) for c in ("taxid", "name", "parent", "rank")]
    for k, rank in enumerate(ranks, 1):
        columns.append(ladder.answer_id(k).alias(f"{rank}_taxid"))
        columns.append(ladder.answer_name(k).alias(f"{rank}_name"))
    return found.select(*columns)


def trace_filter(trace: DataFrame, rank: str, keep: bool = True) -> DataFrame:
    """Rows of a trace table with (or, if not `keep`, without) the given rank.

    Of a trace store only the folders of such ranks are read.
    """
    kept = trace.where(F.col("rank") == rank if keep else F.col("rank") != rank)
    if RANK_FOLDER not in trace.columns:
        return kept
    folder, wanted = F.col(RANK_FOLDER), F.lit(f"{RANK_MARK}{rank}")
    return kept.where(folder == wanted if keep else folder != wanted).drop(RANK_FOLDER)


def trace_of(trace: DataFrame, taxid: int) -> DataFrame:
    """The row of one taxid; of a trace store the files' ranges and bloom filters leave one to read."""
    return trace.where(F.col("taxid") == taxid).drop(RANK_FOLDER)


def trace_counts(trace: DataFrame) -> DataFrame:
    """One row: all taxids of a trace table, those of rank species, those without rank."""
    return trace.agg(
        F.count("taxid").alias("all_rows"),
        F.count_if(F.col("rank") == "species").alias("species_rows"),
        F.count_if(F.col("rank") == NO_RANK).alias("no_rank_rows"),
    )


def annotate_hits(resolved: DataFrame, trace: DataFrame, stored: bool = False) -> DataFrame:
    """Resolved accessions (acc_ver, freq, taxid) beside their lineage columns.

    Accessions without a trace keep null lineage columns. A `trace` that is stored already (a
    bucketed table, say) is taken as it stands; see `stored`.
    """
    if not stored:
        trace = stage(trace)
    lineage = [c for c in trace.columns if c != "taxid"]
    dim = derived(trace.withColumnRenamed("taxid", "_id"), trace)
    return lookup(resolved, dim, "taxid", "_id").select(*resolved.columns, *lineage)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows of several tables: table_name, n_rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
