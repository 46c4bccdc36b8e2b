"""A taxonomy, an accession map and hit lines derived from the sales tables.

Regions, nations, customers and orders become four ranks of a tree; orders become
accessions; line items become hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxid, name, parent, rank."""
    fixed = spark.range(1).selectExpr(
        "stack(2, 1L, 'root', 1L, 'no rank', 999999L, 'self loop', 999999L, 'no rank')"
        " AS (taxid, name, parent, rank)"
    )
    regions = table(spark, sf_dir, "region").selectExpr(
        "CAST(1000 + r_regionkey AS BIGINT) AS taxid",
        "r_name AS name",
        "1L AS parent",
        "'superkingdom' AS rank",
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "CAST(2000 + n_nationkey AS BIGINT) AS taxid",
        "n_name AS name",
        "CAST(1000 + n_regionkey AS BIGINT) AS parent",
        "'family' AS rank",
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "1000000 + c_custkey AS taxid",
        "c_name AS name",
        "CASE WHEN c_custkey % 17 = 0 THEN 88888888L"
        " ELSE CAST(2000 + c_nationkey AS BIGINT) END AS parent",
        "CASE WHEN c_custkey % 11 = 0 THEN 'no rank' ELSE 'genus' END AS rank",
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "1000000000 + o_orderkey AS taxid",
        "concat('order ', o_orderkey) AS name",
        "CASE WHEN o_orderkey % 101 = 0 THEN 999999L"
        " WHEN o_orderkey % 5 = 4 THEN 1000000000 + o_orderkey - 1"
        " ELSE 1000000 + o_custkey END AS parent",
        "CASE WHEN o_orderkey % 5 = 4 THEN 'no rank'"
        " WHEN o_orderkey % 23 = 0 THEN 'varietas' ELSE 'species' END AS rank",
    )
    return fixed.union(regions).union(nations).union(customers).union(orders)


def acc_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acc, acc_ver, taxid, gi; some rows twice."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderkey % 13 <> 0")
        .selectExpr(
            "concat('OR_', o_orderkey) AS acc",
            "concat('OR_', o_orderkey, '.1') AS acc_ver",
            "1000000000 + o_orderkey AS taxid",
            "o_orderkey AS gi",
            "explode(array_repeat(0, IF(o_orderkey % 50 = 1, 2, 1))) AS copy",
        )
        .drop("copy")
    )


def accession_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of accession files (line, number): the map, and what is odd or wrong in such files."""
    good = acc_taxid(spark, sf_dir).selectExpr(
        "concat_ws('\t', acc, concat(acc_ver, ' '), concat(' ', taxid), gi) AS line", "gi AS number"
    )
    odd = table(spark, sf_dir, "orders").selectExpr(
        "CASE o_orderkey % 7"
        " WHEN 0 THEN concat('\t', 'NF_', o_orderkey, '.1\t', o_orderkey, '\t')"
        " WHEN 1 THEN concat('accession', o_orderkey, '\tAC_', o_orderkey, '.1\t', o_orderkey, '\tNULL')"
        " WHEN 2 THEN concat('BT_', o_orderkey, '\tBT_', o_orderkey, '.1\tnone\t1')"
        " WHEN 3 THEN concat('SH_', o_orderkey, '\tSH_', o_orderkey, '.1\t7')"
        " WHEN 4 THEN concat('LG_', o_orderkey, '\tLG_', o_orderkey, '.1\t7\t1\textra')"
        " WHEN 5 THEN concat('BG_', o_orderkey, '\tBG_', o_orderkey, '.1\t7\tx1')"
        " ELSE concat('accession\tEX_', o_orderkey, '.1\t', o_orderkey, '\t5') END AS line",
        "o_orderkey AS number",
    )
    return good.union(odd)


def odd_tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree records that are odd or wrong: line."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CASE o_orderkey % 5"
        " WHEN 0 THEN concat(2000000000 + o_orderkey, ',,1,species')"
        " WHEN 1 THEN concat(o_orderkey, 'x,broken id,1,species')"
        " WHEN 2 THEN concat(2000000000 + o_orderkey, ',nine,1,species,extra')"
        " WHEN 3 THEN concat(2000000000 + o_orderkey, ',lost parent,none,species')"
        " ELSE concat(2000000000 + o_orderkey, ',short') END AS line"
    )


def odd_name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a names dump that must be refused: line."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 < 3").selectExpr(
        "CASE o_orderkey % 4"
        " WHEN 0 THEN concat('x', o_orderkey, '\t|\tno number\t|\t\t|\tscientific name\t|')"
        " WHEN 1 THEN concat(o_orderkey, '\t|\tshort')"
        " ELSE concat(o_orderkey, '\t|\ta tab\tinside\t|\t\t|\tscientific name\t|') END AS line"
    )


def odd_node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a nodes dump that must be refused: line."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 < 3").selectExpr(
        "CASE o_orderkey % 4"
        " WHEN 0 THEN concat(o_orderkey, '\t|\tnone\t|\tspecies\t|')"
        " WHEN 1 THEN concat(o_orderkey, '|1|species|')"
        " ELSE concat('x', o_orderkey, '\t|\t1\t|\tspecies\t|') END AS line"
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line; the accession is field 3 when split on a bar."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 7 THEN concat('x|', l_orderkey, '|bad')"
        " WHEN l_linenumber = 6"
        " THEN concat('read', l_partkey, '\t', 'gi|', l_orderkey, '|ref|Z', l_orderkey, '.1|')"
        " ELSE concat('read', l_partkey, '\t', 'gi|', l_orderkey, '|ref|OR_', l_orderkey, '.1|',"
        " '\t', l_linenumber) END AS line"
    )
