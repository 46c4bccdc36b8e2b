"""Accession maps laid out by subtree, so that everything below a taxid is one slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import lookup
from .lineage import Taxonomy, as_taxonomy
from .staging import derived

# Slices that an accession map is cut into.
SLICES = 256


def cluster_accessions(
    acc_map: DataFrame, tree: DataFrame | Taxonomy, path: str, slices: int = SLICES
) -> None:
    """Store an accession map by the entry numbers of its taxids, with the numbers themselves.

    path/rows    acc, acc_ver, taxid, gi, entry; a folder for every `width` numbers (slice), ranged and
                 sorted by entry. A taxid with very many rows is dealt to several files. Taxids that the
                 tree does not know, or has in a cycle, go to a folder of their own (slice -1).
    path/ranges  taxid, entry, size of every node, sorted by taxid.
    path/width   one row: width.
    """
    numbered = as_taxonomy(tree).intervals()
    spark = acc_map.sparkSession
    last = numbered.agg(F.max("entry")).first()[0] or 0
    width = last // slices + 1
    spark.range(1).select(F.lit(width).cast("long").alias("width")).write.mode("overwrite").parquet(f"{path}/width")
    numbered.repartitionByRange("taxid").sortWithinPartitions("taxid").write.mode("overwrite").parquet(f"{path}/ranges")
    places = derived(numbered.select(F.col("taxid").alias("_id"), F.col("entry")), numbered)
    found = lookup(acc_map.select("acc", "acc_ver", "taxid", "gi"), places, "taxid", "_id").drop("_id")
    sliced = found.withColumn("slice", F.coalesce(F.floor(F.col("entry") / width), F.lit(-1)).cast("long"))
    order = ["slice", "entry", "acc_ver", "gi"]
    (
        sliced.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("slice")
        .parquet(f"{path}/rows")
    )


def accessions_below(spark: SparkSession, path: str, taxid: int) -> DataFrame:
    """Distinct accessions of one taxid and of everything below it: taxid (as asked), acc_ver.

    Of a map stored by `cluster_accessions` only the slices with numbers of the subtree are read.
    A taxid that has no number (unknown, or on a cycle) gives its own accessions only.
    """
    width = spark.read.parquet(f"{path}/width").first()["width"]
    schema = "acc string, acc_ver string, taxid long, gi long, entry long, slice long"
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    place = spark.read.parquet(f"{path}/ranges").where(F.col("taxid") == taxid).first()
    if place is None:
        below = rows.where((F.col("slice") == -1) & (F.col("taxid") == taxid))
    else:
        first, last = place["entry"], place["entry"] + place["size"] - 1
        below = rows.where(
            F.col("slice").between(first // width, last // width) & F.col("entry").between(first, last)
        )
    return below.select(F.lit(taxid).cast("long").alias("taxid"), "acc_ver").distinct()
