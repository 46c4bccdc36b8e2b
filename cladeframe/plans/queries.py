"""Every registered query: (spark, sf_dir) -> DataFrame, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cladeframe as cf

from ..operators.staging import fresh_path
from ..schemas import RANKS
from . import derived

Query = Callable[[SparkSession, str], DataFrame]

SEP, COL = "|", 3
LIMIT = 2
HOPS = 3
LEVELS_UP = 5
FAMILY = 2003
FIRST_ORDER = 1_000_000_001


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.parse_hits(derived.hits(spark, sf_dir), SEP, COL)


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.accession_frequency(_parsed(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.resolve_accessions(_frequency(spark, sf_dir), derived.acc_taxid(spark, sf_dir))


def _ids(tree: DataFrame) -> DataFrame:
    """Every taxid and every parent, so that missing nodes are asked for too."""
    return tree.select("taxid").union(tree.select("parent")).distinct()


def _grouped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived tree under names that many nodes share."""
    segments = derived.table(spark, sf_dir, "customer").selectExpr(
        "1000000 + c_custkey AS taxid", "c_mktsegment AS shared"
    )
    priorities = derived.table(spark, sf_dir, "orders").selectExpr(
        "1000000000 + o_orderkey AS taxid", "o_orderpriority AS shared"
    )
    return (
        derived.tree(spark, sf_dir)
        .join(segments.union(priorities), "taxid", "left")
        .select("taxid", F.coalesce("shared", "name").alias("name"), "parent", "rank")
    )


def _names(spark: SparkSession, sf_dir: str, tree: DataFrame) -> DataFrame:
    """Names of the tree and, as unknown ones, of suppliers."""
    suppliers = derived.table(spark, sf_dir, "supplier").selectExpr("s_name AS name")
    return tree.select("name").union(suppliers).distinct()


def _accession_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Five accession files with headers, odd accessions and lines that must be refused."""
    path = fresh_path(spark)
    parts = range(5)
    lines = derived.accession_lines(spark, sf_dir).selectExpr("line", f"number % {len(parts)} AS part")
    headers = spark.range(len(parts)).selectExpr(
        "concat_ws('\t', 'accession', 'accession.version', 'taxid', 'gi') AS line", "id AS part"
    )
    lines.union(headers).write.partitionBy("part").text(path)
    return [f"{path}/part={i}" for i in parts]


def accession_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    derived.accession_lines(spark, sf_dir).select("line").write.text(path)
    return cf.read_accession_map(spark, path)


def union_accession_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.read_accession_map(spark, _accession_files(spark, sf_dir))


def accession_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.accession_rejects(spark, _accession_files(spark, sf_dir))


def _tree_files(spark: SparkSession, sf_dir: str) -> list[str]:
    path = fresh_path(spark)
    cf.write_tree_csv(derived.tree(spark, sf_dir), f"{path}/good")
    derived.odd_tree_lines(spark, sf_dir).write.text(f"{path}/odd")
    return [f"{path}/good", f"{path}/odd"]


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.read_tree(spark, _tree_files(spark, sf_dir))


def tree_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.tree_rejects(spark, _tree_files(spark, sf_dir))


def tree_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    cf.write_tree(derived.tree(spark, sf_dir), path)
    return spark.read.parquet(path)


def hit_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit lines written to three files, with both kinds of line end, and read back."""
    path = fresh_path(spark)
    lines = derived.hits(spark, sf_dir).selectExpr("line", "length(line) % 3 AS part")
    lines.where("part = 0").select("line").write.text(f"{path}/0")
    lines.where("part = 1").select("line").write.option("lineSep", "\r\n").text(f"{path}/1")
    lines.where("part = 2").select("line").write.option("compression", "gzip").text(f"{path}/2")
    return cf.parse_hits(cf.read_hits(spark, [f"{path}/{i}" for i in range(3)]), SEP, COL)


def _dump_files(spark: SparkSession, sf_dir: str) -> str:
    """Names and nodes dumps of the derived tree, with lines that must be refused."""
    path = fresh_path(spark)
    tree = derived.tree(spark, sf_dir)
    name_line = "concat_ws('\t', taxid, '|', {}, '|', '', '|', '{}', '|') AS line"
    node_line = "concat_ws('\t', taxid, '|', {}, '|', {}, '|') AS line"
    own = tree.selectExpr(name_line.format("name", "scientific name"))
    synonyms = tree.where("taxid % 3 = 0").selectExpr(
        name_line.format("concat('also ', name)", "synonym")
    )
    late = tree.where("taxid % 7 = 0").selectExpr(
        name_line.format("concat('late ', name)", "scientific name")
    )
    synonyms.union(own).write.text(f"{path}/names-0")
    late.write.text(f"{path}/names-1")
    placed = tree.where("taxid % 19 <> 0")
    placed.selectExpr(
        node_line.format("IF(taxid % 29 = 0, 5, parent)", "IF(taxid % 29 = 0, 'old', rank)")
    ).write.text(f"{path}/nodes-0")
    placed.where("taxid % 29 = 0").selectExpr(node_line.format("parent", "rank")).write.text(
        f"{path}/nodes-1"
    )
    derived.odd_name_lines(spark, sf_dir).write.text(f"{path}/names-2")
    derived.odd_node_lines(spark, sf_dir).write.text(f"{path}/nodes-2")
    return path


def _dump(path: str, kind: str) -> list[str]:
    return [f"{path}/{kind}-{i}" for i in range(3)]


def build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _dump_files(spark, sf_dir)
    return cf.build_tree(
        cf.read_names(spark, _dump(path, "names")), cf.read_nodes(spark, _dump(path, "nodes"))
    )


def names_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.names_rejects(spark, _dump(_dump_files(spark, sf_dir), "names"))


def nodes_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.nodes_rejects(spark, _dump(_dump_files(spark, sf_dir), "nodes"))


def line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of accession files, tree files, dumps and hash input by verdict, each file scanned once."""
    path = _dump_files(spark, sf_dir)
    # Places in files (path, block, number) are for telling first from later rows; verdicts need none.
    settled = {
        "accessions": cf.settle(cf.scan_accession_map(spark, _accession_files(spark, sf_dir), headers=True)),
        "tree": cf.settle(cf.scan_tree(spark, _tree_files(spark, sf_dir))),
        "names": cf.settle(cf.scan_names(spark, _dump(path, "names")).drop("position")),
        "nodes": cf.settle(cf.scan_nodes(spark, _dump(path, "nodes")).drop("position")),
        "hashes": cf.settle(cf.scan_hash_lines(_hash_lines(spark, sf_dir), headers=True)),
    }
    out = None
    for name, both in settled.items():
        kept = both.kept.groupBy().agg(F.count("*").alias("n")).select(F.lit("kept").alias("verdict"), "n")
        gone = both.rejects.groupBy(F.col("reject_reason").alias("verdict")).agg(F.count("*").alias("n"))
        part = kept.unionByName(gone).select(F.lit(name).alias("file"), "verdict", "n")
        out = part if out is None else out.unionByName(part)
    return out


def settled_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accession map as kept by a scan that writes rows and refused lines at once."""
    return cf.settle(cf.scan_accession_map(spark, _accession_files(spark, sf_dir), headers=True)).kept


def hit_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.hit_rejects(_parsed(spark, sf_dir))


def hit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.hit_counters(_parsed(spark, sf_dir))


def accver_by_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _ids(derived.tree(spark, sf_dir))
    return cf.accver_by_taxid(keys, derived.acc_taxid(spark, sf_dir))


def taxid_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _grouped_tree(spark, sf_dir)
    return cf.taxid_by_name(_names(spark, sf_dir, tree), tree, LIMIT)


def node_by_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.node_by_taxid(_ids(tree), tree)


def node_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _grouped_tree(spark, sf_dir)
    return cf.node_by_name(_names(spark, sf_dir, tree), tree)


def children_by_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.children(_ids(tree), tree)


def children_by_taxid_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.children(_ids(tree), tree, LIMIT)


def children_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _grouped_tree(spark, sf_dir)
    return cf.children_by_name(_names(spark, sf_dir, tree), tree)


def rank_by_accver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.rank_by_accver(
        _frequency(spark, sf_dir), derived.acc_taxid(spark, sf_dir), derived.tree(spark, sf_dir)
    )


def ancestor_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.ancestor_at_rank(_ids(tree), tree, RANKS)


def rank_name_by_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.rank_name(_ids(tree), tree, RANKS)


def rank_name_by_accver(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _resolved(spark, sf_dir).select("acc_ver", "taxid")
    return cf.rank_name(keys, derived.tree(spark, sf_dir), RANKS)


def lineage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.lineage(_ids(tree), tree)


def lineage_by_accver(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _resolved(spark, sf_dir).select("acc_ver", "taxid")
    return cf.lineage(keys, derived.tree(spark, sf_dir))


def lineage_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    found = cf.paths(_ids(tree), tree)
    text = F.array_join(F.col("path").cast("array<string>"), "/")
    return found.select("taxid", text.alias("path"), "status")


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.descendants(_ids(tree), tree)


def descendant_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.descendant_accessions(_ids(tree), tree, derived.acc_taxid(spark, sf_dir))


def parent_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.parent_hops(derived.tree(spark, sf_dir), HOPS)


def nth_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = derived.tree(spark, sf_dir)
    return cf.nth_parent(_ids(tree), tree, LEVELS_UP)


def subtree_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessions of one family, as a slice of the map laid out by subtree."""
    path = fresh_path(spark)
    cf.cluster_accessions(derived.acc_taxid(spark, sf_dir), derived.tree(spark, sf_dir), path)
    return cf.accessions_below(spark, path, FAMILY)


def distinct_taxids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.distinct_taxids(derived.acc_taxid(spark, sf_dir))


def accessions_per_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.accessions_per_taxid(derived.acc_taxid(spark, sf_dir))


def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.seed_join(distinct_taxids(spark, sf_dir), derived.tree(spark, sf_dir))


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_table(distinct_taxids(spark, sf_dir), derived.tree(spark, sf_dir), cf.CASCADE)


def trace_table_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_table(distinct_taxids(spark, sf_dir), derived.tree(spark, sf_dir), cf.DIRECT)


def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    cf.write_trace(trace_table(spark, sf_dir), path)
    return cf.trace_filter(cf.read_trace(spark, path), "species")


def trace_filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_filter(trace_table(spark, sf_dir), "species", keep=False)


def trace_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of one taxid, that of the first order."""
    return cf.trace_of(trace_table(spark, sf_dir), FIRST_ORDER)


def trace_species_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    cf.write_trace(trace_table(spark, sf_dir), path, rank="species")
    return cf.read_trace(spark, path)


def _trace_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace store, of which one rank has been written once more."""
    path = fresh_path(spark)
    trace = cf.stage(trace_table(spark, sf_dir))
    cf.write_trace_store(trace, path)
    cf.write_trace_store(cf.trace_filter(trace, "species"), path)
    return cf.read_trace(spark, path)


def trace_store_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_filter(_trace_store(spark, sf_dir), "species")


def trace_store_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_of(_trace_store(spark, sf_dir), FIRST_ORDER)


def trace_view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    cf.register(trace_table(spark, sf_dir), "trace_of_orders")
    return spark.sql(
        "SELECT rank, species_taxid, count(taxid) AS n FROM trace_of_orders GROUP BY rank, species_taxid"
    )


def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.trace_counts(trace_table(spark, sf_dir))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.table_counts(
        {
            "acc_taxid": derived.acc_taxid(spark, sf_dir),
            "distinct_taxids": distinct_taxids(spark, sf_dir),
            "tree": derived.tree(spark, sf_dir),
            "hits": derived.hits(spark, sf_dir),
        }
    )


def annotate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.annotate_hits(_resolved(spark, sf_dir), trace_table(spark, sf_dir))


def annotate_hits_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the trace table stored in buckets of taxids."""
    name = f"trace_{fresh_path(spark).rsplit('/', 1)[-1]}"
    cf.save_trace_table(trace_table(spark, sf_dir), name, 8)
    return cf.annotate_hits(_resolved(spark, sf_dir), spark.table(name), stored=True)


def taxid_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.taxid_tally(_resolved(spark, sf_dir))


def rank_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.rank_rollup(_resolved(spark, sf_dir), derived.tree(spark, sf_dir))


def rollup_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.rollup_children(_resolved(spark, sf_dir), derived.tree(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.report(rank_rollup(spark, sf_dir))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.report_lines(report(spark, sf_dir))


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report as a file, and how often it has each line."""
    path = fresh_path(spark)
    cf.write_lines(report_lines(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def accession_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessions resolved against the map stored both ways."""
    acc_map = derived.acc_taxid(spark, sf_dir)
    path = fresh_path(spark)
    cf.write_accession_map(acc_map, path)
    name = f"accessions_{path.rsplit('/', 1)[-1]}"
    cf.save_accession_table(acc_map, name, 8)
    keys = _frequency(spark, sf_dir)
    ranged = cf.resolve_accessions(keys, spark.read.parquet(path))
    bucketed = cf.resolve_accessions(keys, spark.table(name)).withColumnRenamed("taxid", "bucketed_taxid")
    return ranged.join(bucketed, ["acc_ver", "freq"])


def report_html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.report_html_rows(report(spark, sf_dir))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.report_summary(hit_counters(spark, sf_dir), "sales", "orders as taxa")


def _hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an accession file with a header, CR line ends and short lines."""
    lines = derived.acc_taxid(spark, sf_dir).selectExpr(
        "concat(concat_ws('\t', acc, acc_ver, taxid, gi), IF(gi % 3 = 0, '\r', '')) AS line"
    )
    short = derived.table(spark, sf_dir, "orders").selectExpr("concat('OR_', o_orderkey, '\t1') AS line")
    header = spark.range(1).selectExpr("concat_ws('\t', 'accession', 'accession.version', 'taxid', 'gi')")
    return lines.union(short).union(header)


def hash_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.hash_rejects(_hash_lines(spark, sf_dir))


def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of an accession file by way of a TSV."""
    path = fresh_path(spark)
    cf.write_hashes(cf.key_hash(cf.hash_input(_hash_lines(spark, sf_dir))), path)
    return spark.read.csv(path, sep="\t", schema="acc_hash bigint, acc_ver_hash bigint, taxid bigint")


def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.key_collisions(derived.acc_taxid(spark, sf_dir))


def first_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each accession version in two releases of the map the row with the smallest gi."""
    older = derived.acc_taxid(spark, sf_dir).where("gi % 30 < 3").selectExpr(
        "acc", "acc_ver", "taxid + gi % 3 - 1 AS taxid", "gi - gi % 2 AS gi"
    )
    return cf.first_rows(derived.acc_taxid(spark, sf_dir).union(older), "acc_ver", "gi")


QUERIES: dict[str, Query] = {
    "accession_map": accession_map,
    "tree_scan": tree_scan,
    "union_accession_files": union_accession_files,
    "build_tree": build_tree,
    "accession_rejects": accession_rejects,
    "tree_rejects": tree_rejects,
    "names_rejects": names_rejects,
    "nodes_rejects": nodes_rejects,
    "hash_rejects": hash_rejects,
    "line_verdicts": line_verdicts,
    "settled_accessions": settled_accessions,
    "tree_parquet": tree_parquet,
    "hit_file_scan": hit_file_scan,
    "parse_hits": _parsed,
    "hit_rejects": hit_rejects,
    "hit_counters": hit_counters,
    "accession_frequency": _frequency,
    "taxid_by_accver": _resolved,
    "accver_by_taxid": accver_by_taxid,
    "taxid_by_name": taxid_by_name,
    "node_by_taxid": node_by_taxid,
    "node_by_name": node_by_name,
    "children_by_taxid": children_by_taxid,
    "children_by_taxid_limit": children_by_taxid_limit,
    "children_by_name": children_by_name,
    "rank_by_accver": rank_by_accver,
    "ancestor_at_rank": ancestor_at_rank,
    "rank_name_by_taxid": rank_name_by_taxid,
    "rank_name_by_accver": rank_name_by_accver,
    "lineage_trace": lineage_trace,
    "lineage_by_accver": lineage_by_accver,
    "lineage_path": lineage_path,
    "descendants": descendants,
    "descendant_accessions": descendant_accessions,
    "parent_hops": parent_hops,
    "nth_parent": nth_parent,
    "subtree_accessions": subtree_accessions,
    "distinct_taxids": distinct_taxids,
    "accessions_per_taxid": accessions_per_taxid,
    "seed_join": seed_join,
    "trace_table": trace_table,
    "trace_table_direct": trace_table_direct,
    "trace_filter": trace_filter,
    "trace_filter_not": trace_filter_not,
    "trace_point": trace_point,
    "trace_species_parquet": trace_species_parquet,
    "trace_store_filter": trace_store_filter,
    "trace_store_point": trace_store_point,
    "trace_view_sql": trace_view_sql,
    "trace_counts": trace_counts,
    "table_counts": table_counts,
    "annotate_hits": annotate_hits,
    "annotate_hits_stored": annotate_hits_stored,
    "taxid_tally": taxid_tally,
    "rank_rollup": rank_rollup,
    "rollup_children": rollup_children,
    "report": report,
    "report_lines": report_lines,
    "report_file": report_file,
    "accession_stores": accession_stores,
    "report_html_rows": report_html_rows,
    "report_summary": report_summary,
    "key_hash": key_hash,
    "key_collisions": key_collisions,
    "first_accessions": first_accessions,
}
