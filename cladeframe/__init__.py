"""Lineage and hit-report analytics over taxonomies, as Spark DataFrame operations."""

from .functions.ladder import CASCADE, DIRECT
from .operators.hits import accession_frequency, hit_counters, hit_rejects, parse_hits
from .operators.lineage import (
    Taxonomy,
    ancestor_at_rank,
    children,
    descendant_accessions,
    descendants,
    lineage,
    nth_parent,
    parent_hops,
    paths,
    rank_name,
)
from .operators.lookups import (
    accver_by_taxid,
    children_by_name,
    node_by_name,
    node_by_taxid,
    rank_by_accver,
    resolve_accessions,
    taxid_by_name,
)
from .operators.quality import key_collisions, key_hash
from .operators.repeats import first_rows, repeated_keys, split_repeats
from .operators.report import (
    report,
    report_html_rows,
    report_lines,
    report_summary,
)
from .operators.rollup import rank_rollup, rollup_children, taxid_tally
from .operators.staging import clear, scope, stage
from .operators.subtrees import accessions_below, cluster_accessions
from .operators.trace import (
    accessions_per_taxid,
    annotate_hits,
    distinct_taxids,
    seed_join,
    table_counts,
    trace_counts,
    trace_filter,
    trace_of,
    trace_table,
)
from .sources.readers import (
    accession_rejects,
    build_tree,
    hash_input,
    hash_rejects,
    names_rejects,
    nodes_rejects,
    read_accession_map,
    read_hits,
    read_names,
    read_nodes,
    read_trace,
    read_tree,
    scan_accession_map,
    scan_hash_lines,
    scan_names,
    scan_nodes,
    scan_tree,
    tree_rejects,
)
from .sources.settle import Settled, settle
from .sources.writers import (
    register,
    save_accession_table,
    save_trace_table,
    write_accession_map,
    write_hashes,
    write_lines,
    write_trace,
    write_trace_store,
    write_tree,
    write_tree_csv,
)

__all__ = [name for name in dir() if not name.startswith("_")]
