"""Key lookups, answered for a whole table of keys in one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NO_RANK, UNKNOWN_ID, UNKNOWN_NAME
from .joins import first_k, lookup, narrow
from .lineage import Taxonomy, as_taxonomy, children
from .staging import derived, stage


def resolve_accessions(keys: DataFrame, acc_map: DataFrame) -> DataFrame:
    """Add `taxid` to keys with a column acc_ver, one row per accession; -1 if unmapped.

    Copies of an accession in the map never multiply rows: the smallest taxid wins.
    When the keys are provably few, the map is narrowed to them before anything is
    shuffled; else both sides are aggregated on acc_ver, which leaves no hot key.
    """
    keys = stage(keys)
    mapped = acc_map.where(F.col("taxid").isNotNull()).select("acc_ver", "taxid")
    taxids = narrow(mapped, keys, "acc_ver").groupBy("acc_ver").agg(F.min("taxid").alias("taxid"))
    return keys.join(taxids, "acc_ver", "left").select(
        *keys.columns, F.coalesce("taxid", F.lit(UNKNOWN_ID)).cast("bigint").alias("taxid")
    )


def accver_by_taxid(keys: DataFrame, acc_map: DataFrame) -> DataFrame:
    """Distinct accessions mapped to each distinct key: taxid, acc_ver.

    `acc_map` is a stored table; when the keys are many it is scanned twice.
    """
    wanted = stage(keys.select("taxid").distinct())
    mapped = acc_map.select("acc_ver", F.col("taxid").alias("_mapped"))
    found = lookup(mapped, wanted, "_mapped", "taxid", "inner", staged=True)
    return found.select("taxid", "acc_ver").distinct()


def node_by_taxid(keys: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Add name, parent and rank to keys with a column taxid; sentinels where unknown."""
    known = as_taxonomy(tree).nodes
    columns = [F.col(c).alias(f"_{c}") for c in ("name", "parent", "rank")]
    nodes = derived(known.select(F.col("taxid").alias("_id"), *columns), known)
    return lookup(keys, nodes, "taxid", "_id").select(
        *keys.columns,
        F.coalesce("_name", F.lit(UNKNOWN_NAME)).alias("name"),
        F.coalesce("_parent", F.lit(UNKNOWN_ID)).cast("bigint").alias("parent"),
        F.coalesce("_rank", F.lit(NO_RANK)).alias("rank"),
    )


def taxid_by_name(keys: DataFrame, tree: DataFrame | Taxonomy, limit: int = 1) -> DataFrame:
    """The `limit` smallest taxids of each distinct name: name, taxid (-1 if there is none)."""
    wanted = stage(keys.select("name").distinct())
    nodes = as_taxonomy(tree).nodes.select("taxid", F.col("name").alias("_name"))
    found = lookup(nodes, wanted, "_name", "name", "inner", staged=True)
    best = first_k(found.select("name", "taxid"), "name", "taxid", limit)
    return wanted.join(best, "name", "left").select(
        "name", F.coalesce("taxid", F.lit(UNKNOWN_ID)).cast("bigint").alias("taxid")
    )


def node_by_name(keys: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Smallest taxid of each distinct name with its rank and parent: name, taxid, rank, parent."""
    tree = as_taxonomy(tree)
    found = taxid_by_name(keys, tree).withColumnRenamed("name", "_asked")
    return node_by_taxid(found, tree).select(
        F.col("_asked").alias("name"), "taxid", "rank", "parent"
    )


def children_by_name(
    keys: DataFrame, tree: DataFrame | Taxonomy, limit: int | None = None
) -> DataFrame:
    """Direct children of the smallest taxid of each distinct name: name, taxid, child."""
    tree = as_taxonomy(tree)
    named = stage(taxid_by_name(keys, tree).where(F.col("taxid") != UNKNOWN_ID))
    found = children(named, tree, limit)
    names = derived(named.select("name", F.col("taxid").alias("_id")), named)
    # A taxid has one name in the tree, so `names` has one row per taxid.
    return lookup(found, names, "taxid", "_id", "inner").select("name", "taxid", "child")


def rank_by_accver(
    keys: DataFrame, acc_map: DataFrame, tree: DataFrame | Taxonomy
) -> DataFrame:
    """Taxid and rank of each accession: keys' columns, taxid, rank."""
    resolved = resolve_accessions(keys, acc_map)
    return node_by_taxid(resolved, tree).drop("name", "parent")
