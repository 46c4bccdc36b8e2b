"""The registered queries as plain SQL for an independent engine.

Recursive and unoptimised on purpose: these texts share no idea with the operators.
"""

from __future__ import annotations

_CTES = {
    "tree": """
  SELECT CAST(1 AS BIGINT) AS taxid, 'root' AS name, CAST(1 AS BIGINT) AS parent, 'no rank' AS rank
  UNION ALL SELECT CAST(999999 AS BIGINT), 'self loop', CAST(999999 AS BIGINT), 'no rank'
  UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), r_name, CAST(1 AS BIGINT), 'superkingdom'
    FROM region
  UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), n_name,
    CAST(1000 + n_regionkey AS BIGINT), 'family' FROM nation
  UNION ALL SELECT 1000000 + c_custkey, c_name,
    CASE WHEN c_custkey % 17 = 0 THEN CAST(88888888 AS BIGINT)
         ELSE CAST(2000 + c_nationkey AS BIGINT) END,
    CASE WHEN c_custkey % 11 = 0 THEN 'no rank' ELSE 'genus' END FROM customer
  UNION ALL SELECT 1000000000 + o_orderkey, 'order ' || o_orderkey,
    CASE WHEN o_orderkey % 101 = 0 THEN CAST(999999 AS BIGINT)
         WHEN o_orderkey % 5 = 4 THEN 1000000000 + o_orderkey - 1
         ELSE 1000000 + o_custkey END,
    CASE WHEN o_orderkey % 5 = 4 THEN 'no rank' WHEN o_orderkey % 23 = 0 THEN 'varietas'
         ELSE 'species' END FROM orders""",
    "acc_taxid": """
  SELECT 'OR_' || o_orderkey AS acc, 'OR_' || o_orderkey || '.1' AS acc_ver,
    1000000000 + o_orderkey AS taxid, o_orderkey AS gi
  FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL
  SELECT 'OR_' || o_orderkey, 'OR_' || o_orderkey || '.1', 1000000000 + o_orderkey, o_orderkey
  FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 50 = 1""",
    "hits": """
  SELECT CASE WHEN l_linenumber = 7 THEN 'x|' || l_orderkey || '|bad'
    WHEN l_linenumber = 6
      THEN 'read' || l_partkey || chr(9) || 'gi|' || l_orderkey || '|ref|Z' || l_orderkey || '.1|'
    ELSE 'read' || l_partkey || chr(9) || 'gi|' || l_orderkey || '|ref|OR_' || l_orderkey || '.1|'
      || chr(9) || CAST(l_linenumber AS INT) END AS line FROM lineitem""",
    # What must be read from files that hold the map, odd lines and wrong ones.
    "scanned_map": """
  SELECT acc, acc_ver, taxid, gi FROM acc_taxid
  UNION ALL SELECT '', 'NF_' || o_orderkey || '.1', o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'accession' || o_orderkey, 'AC_' || o_orderkey || '.1', o_orderkey, NULL
    FROM orders WHERE o_orderkey % 7 = 1
  UNION ALL SELECT 'accession', 'EX_' || o_orderkey || '.1', o_orderkey, 5
    FROM orders WHERE o_orderkey % 7 = 6""",
    # Lines of dumps that must be refused.
    "refused_names": """
  SELECT CASE o_orderkey % 4
      WHEN 0 THEN concat_ws(chr(9), 'x' || o_orderkey, '|', 'no number', '|', '', '|', 'scientific name', '|')
      WHEN 1 THEN concat_ws(chr(9), o_orderkey, '|', 'short')
      ELSE concat_ws(chr(9), o_orderkey, '|', 'a tab', 'inside', '|', '', '|', 'scientific name', '|') END AS line,
    CASE o_orderkey % 4 WHEN 0 THEN 'bad_taxid' ELSE 'wrong_columns' END AS reject_reason
  FROM orders WHERE o_orderkey % 4 < 3""",
    "refused_nodes": """
  SELECT CASE o_orderkey % 4 WHEN 0 THEN concat_ws(chr(9), o_orderkey, '|', 'none', '|', 'species', '|')
      WHEN 1 THEN o_orderkey || '|1|species|'
      ELSE concat_ws(chr(9), 'x' || o_orderkey, '|', '1', '|', 'species', '|') END AS line,
    CASE o_orderkey % 4 WHEN 0 THEN 'bad_parent' WHEN 1 THEN 'wrong_columns' ELSE 'bad_taxid' END AS reject_reason
  FROM orders WHERE o_orderkey % 4 < 3""",
    # Lines with their accession.
    "parsed": """
  SELECT line,
    CASE WHEN regexp_matches(field, '^[A-Z][A-Z]_?[0-9]+\\.[0-9]+$') THEN field END AS acc_ver,
    CASE WHEN n_fields <= 3 THEN 'too_few_columns'
         WHEN NOT regexp_matches(field, '^[A-Z][A-Z]_?[0-9]+\\.[0-9]+$') THEN 'pattern_miss'
    END AS reject_reason
  FROM (SELECT line, trim(split_part(line, '|', 4)) AS field,
               len(string_split(line, '|')) AS n_fields FROM hits)""",
    "freq": """
  SELECT acc_ver, count(*) AS freq FROM parsed WHERE acc_ver IS NOT NULL GROUP BY acc_ver""",
    "resolved": """
  SELECT f.acc_ver, f.freq, coalesce(m.taxid, -1) AS taxid
  FROM freq f LEFT JOIN (SELECT acc_ver, min(taxid) AS taxid FROM acc_taxid GROUP BY acc_ver) m
    ON f.acc_ver = m.acc_ver""",
    "ids": """
  SELECT taxid FROM tree UNION SELECT parent FROM tree""",
    # The tree under shared names, and the names asked for.
    "grouped": """
  SELECT t.taxid, coalesce(c_mktsegment, o_orderpriority, t.name) AS name, t.parent, t.rank
  FROM tree t LEFT JOIN customer ON t.taxid = 1000000 + c_custkey
    LEFT JOIN orders ON t.taxid = 1000000000 + o_orderkey""",
    "asked": """
  SELECT name FROM grouped UNION SELECT s_name FROM supplier""",
    "first_named": """
  SELECT a.name, coalesce(min(g.taxid), -1) AS taxid
  FROM asked a LEFT JOIN grouped g ON g.name = a.name GROUP BY a.name""",
    # Every node with every node above it, and how its chain ends.
    "walk": """
  SELECT taxid AS seed, 0 AS depth, taxid, parent, rank, name FROM tree
  UNION ALL
  SELECT w.seed, w.depth + 1, t.taxid, t.parent, t.rank, t.name
  FROM walk w JOIN tree t ON t.taxid = w.parent WHERE w.parent <> w.taxid""",
    "tip": """
  SELECT seed, last_depth, CASE WHEN last_parent = last_id THEN last_id END AS top,
    CASE WHEN last_parent <> last_id THEN last_parent END AS gap
  FROM (SELECT seed, max(depth) AS last_depth, arg_max(taxid, depth) AS last_id,
          arg_max(parent, depth) AS last_parent FROM walk GROUP BY seed)""",
    "ladder": """
  SELECT * FROM (VALUES (1, 'species'), (2, 'genus'), (3, 'family'), (4, 'superkingdom')) v(lv, rk)""",
    "nearest": """
  SELECT seed, lower(rank) AS rk, arg_min(taxid, depth) AS hit FROM walk GROUP BY seed, lower(rank)""",
    "anc": """
  SELECT p.seed, l.rk, coalesce(n.hit, p.top, -1) AS anc,
    CASE WHEN n.hit IS NOT NULL THEN 'found' WHEN p.top IS NOT NULL THEN 'top'
         ELSE 'unresolved' END AS status
  FROM tip p CROSS JOIN ladder l LEFT JOIN nearest n ON n.seed = p.seed AND n.rk = l.rk""",
    # Answers of which each is looked up from the one before.
    "cascade": """
  SELECT t.taxid AS id_0, coalesce(s.anc, -1) AS id_1, coalesce(g.anc, -1) AS id_2,
    coalesce(f.anc, -1) AS id_3, coalesce(k.anc, -1) AS id_4
  FROM tree t LEFT JOIN anc s ON s.seed = t.taxid AND s.rk = 'species'
    LEFT JOIN anc g ON g.seed = s.anc AND g.rk = 'genus'
    LEFT JOIN anc f ON f.seed = g.anc AND f.rk = 'family'
    LEFT JOIN anc k ON k.seed = f.anc AND k.rk = 'superkingdom'""",
    # Lineages of every id, missing ones and -1 included.
    "steps": """
  SELECT w.seed, w.depth, w.taxid AS step_taxid, w.rank, w.name,
    CASE WHEN p.top IS NULL THEN 'unresolved' ELSE 'top' END AS status
  FROM walk w JOIN tip p ON p.seed = w.seed
  UNION ALL SELECT seed, last_depth + 1, gap, 'no rank', 'unknown', 'unresolved'
    FROM tip WHERE gap IS NOT NULL
  UNION ALL SELECT seed, last_depth + 2, -1, 'no rank', 'unknown', 'unresolved'
    FROM tip WHERE gap IS NOT NULL
  UNION ALL SELECT taxid, 0, taxid, 'no rank', 'unknown', 'unresolved'
    FROM ids WHERE taxid NOT IN (SELECT taxid FROM tree)
  UNION ALL SELECT taxid, 1, -1, 'no rank', 'unknown', 'unresolved'
    FROM ids WHERE taxid NOT IN (SELECT taxid FROM tree)
  UNION ALL SELECT -1, 0, -1, 'no rank', 'unknown', 'unresolved'""",
    "labels": """
  SELECT i.taxid, l.rk,
    CASE WHEN a.status = 'found' THEN (SELECT any_value(name) FROM tree t WHERE t.taxid = a.anc)
         WHEN a.status = 'top' AND a.anc = 1 THEN 'Taxonomy_Tree_Root'
         ELSE 'Invalid_TaxID' END AS label
  FROM (SELECT taxid FROM ids UNION SELECT -1) i CROSS JOIN ladder l
    LEFT JOIN anc a ON a.seed = i.taxid AND a.rk = l.rk""",
    "pairs": """
  SELECT taxid, seed AS descendant FROM walk WHERE depth > 0
  UNION ALL SELECT gap, seed FROM tip WHERE gap IS NOT NULL""",
    "trace": """
  SELECT t.taxid, t.name, t.parent, t.rank,
    c.id_1 AS species_taxid, coalesce(n1.name, 'unknown') AS species_name,
    c.id_2 AS genus_taxid, coalesce(n2.name, 'unknown') AS genus_name,
    c.id_3 AS family_taxid, coalesce(n3.name, 'unknown') AS family_name,
    c.id_4 AS superkingdom_taxid, coalesce(n4.name, 'unknown') AS superkingdom_name
  FROM tree t JOIN cascade c ON c.id_0 = t.taxid
    LEFT JOIN tree n1 ON n1.taxid = c.id_1 LEFT JOIN tree n2 ON n2.taxid = c.id_2
    LEFT JOIN tree n3 ON n3.taxid = c.id_3 LEFT JOIN tree n4 ON n4.taxid = c.id_4
  WHERE t.taxid IN (SELECT taxid FROM acc_taxid)""",
    "tally": """
  SELECT taxid, CAST(sum(freq) AS BIGINT) AS tally, count(*) AS n_children
  FROM resolved GROUP BY taxid""",
    # Rollup one level at a time.
    "lv0": """
  SELECT y.taxid, coalesce(c.id_1, -1) AS up, y.tally, y.n_children
  FROM tally y LEFT JOIN cascade c ON c.id_0 = y.taxid""",
    "lv1": """
  SELECT l.up AS taxid, coalesce(any_value(a.anc), -1) AS up, CAST(sum(tally) AS BIGINT) AS tally,
    count(*) AS n_children
  FROM lv0 l LEFT JOIN anc a ON a.seed = l.up AND a.rk = 'genus' GROUP BY l.up""",
    "lv2": """
  SELECT l.up AS taxid, coalesce(any_value(a.anc), -1) AS up, CAST(sum(tally) AS BIGINT) AS tally,
    count(*) AS n_children
  FROM lv1 l LEFT JOIN anc a ON a.seed = l.up AND a.rk = 'family' GROUP BY l.up""",
    "lv3": """
  SELECT l.up AS taxid, coalesce(any_value(a.anc), -1) AS up, CAST(sum(tally) AS BIGINT) AS tally,
    count(*) AS n_children
  FROM lv2 l LEFT JOIN anc a ON a.seed = l.up AND a.rk = 'superkingdom' GROUP BY l.up""",
    "lv4": """
  SELECT up AS taxid, CAST(NULL AS BIGINT) AS up, CAST(sum(tally) AS BIGINT) AS tally,
    count(*) AS n_children FROM lv3 GROUP BY up""",
    "levels": """
  SELECT 0 AS lv, 'subspecies' AS rank_level, * FROM lv0
  UNION ALL SELECT 1, 'species', * FROM lv1
  UNION ALL SELECT 2, 'genus', * FROM lv2
  UNION ALL SELECT 3, 'family', * FROM lv3
  UNION ALL SELECT 4, 'superkingdom', * FROM lv4""",
    "rollup_rows": """
  SELECT v.lv, v.rank_level, v.taxid, v.up AS parent_taxid,
    CASE WHEN v.lv = 0 THEN coalesce(t.name, 'unknown')
         WHEN t.rank = v.rank_level THEN t.name
         WHEN v.taxid = 1 THEN 'Taxonomy_Tree_Root' ELSE 'Invalid_TaxID' END AS rank_name,
    CASE WHEN v.lv = 0 THEN coalesce(t.rank, 'no rank') END AS mapped_rank,
    v.tally, v.n_children
  FROM levels v LEFT JOIN tree t ON t.taxid = v.taxid""",
    "ranked": """
  SELECT lv, rank_level, taxid, rank_name, mapped_rank, tally,
    tally / sum(tally) OVER (PARTITION BY lv) * 100 AS percentage,
    CAST(sum(tally) OVER (PARTITION BY lv ORDER BY tally DESC, rank_name, taxid
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tally,
    row_number() OVER (ORDER BY lv, tally DESC, rank_name, taxid) AS line_no
  FROM rollup_rows""",
    "shown": """
  SELECT *, rpad(txt, CAST(greatest(length(txt), 60) AS INT), ' ') AS display,
    lpad(CAST(taxid AS VARCHAR), CAST(greatest(length(CAST(taxid AS VARCHAR)), 7) AS INT), ' ')
      AS taxid_text
  FROM (SELECT *, CASE WHEN lv = 0 THEN rank_name || ' (' || mapped_rank || ')'
                       ELSE rank_name END AS txt FROM ranked)""",
}


def _needs(text: str) -> list[str]:
    """The named parts that a text refers to, in order of definition."""
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
    return [name for name in _CTES if name in words]


def _sql(body: str) -> str:
    """Put the parts that a query uses, directly or not, in front of it."""
    used: set[str] = set()
    todo = _needs(body)
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += _needs(_CTES[name])
    parts = [f"{name} AS ({_CTES[name]})" for name in _CTES if name in used]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body


_HOPS = ", ".join(
    f"h{i}.taxid AS taxid_t{i}, h{i}.name AS name_t{i}, h{i}.parent AS parent_t{i},"
    f" h{i}.rank AS rank_t{i}"
    for i in range(4)
)



def _signed(column: str) -> str:
    """The first 64 bits of a text's MD5 as a signed number."""
    bits = f"CAST(CAST('0x' || substr(md5({column}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"""CAST(CASE WHEN {bits} >= 9223372036854775808
    THEN {bits} - 18446744073709551616 ELSE {bits} END AS BIGINT)"""


# Headings, row layouts and titles of the printed report, as it prints them.
_COLUMN_HEADING = "   count  percentage  Rank name                                                         [  taxid  ] (running tally)"  # noqa: E501
_HTML_ROW = "<TR><TD>%8d</TD><TD>%8.4f %%</TD><TD>%s</TD><TD><A HREF=''http://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=%d''>\t%s</A></TD></TR>"  # noqa: E501
_SUMMARY_TITLES = (
    "Job Name:             ",
    "Job Desc:             ",
    "Unique Acc.V Count:   ",
    "Total rows processed: ",
    "Rejected rows:        ",
)
_LINES = f"""SELECT line_no + 3 * lv + 2 AS line_no,
  printf('%8d  %8.4f %%    %s    [ %s ] ( %11d )', tally, percentage, display, taxid_text,
    running_tally) AS line FROM shown
  UNION ALL
  SELECT n_before + 3 * l.lv + o.k + CASE WHEN o.k = 3 THEN n_own ELSE 0 END,
    CASE WHEN o.k = 3 THEN '' WHEN o.k = 2 THEN '{_COLUMN_HEADING}'
         WHEN l.lv = 0 THEN '           =================== Taxid at Accession.V =================='
         ELSE '           =================== Rank Level: ' || l.rk || '  ==================' END
  FROM (SELECT v.lv, v.rk, (SELECT count(*) FROM ranked r WHERE r.lv < v.lv) AS n_before,
          (SELECT count(*) FROM ranked r WHERE r.lv = v.lv) AS n_own
        FROM (SELECT lv, rk FROM ladder UNION ALL SELECT 0, 'subspecies') v) l
  CROSS JOIN (VALUES (1), (2), (3)) o(k)"""

ORACLE: dict[str, str] = {
    name: _sql(body)
    for name, body in {
        "accession_map": "SELECT acc, acc_ver, taxid, gi FROM scanned_map",
        "union_accession_files": "SELECT acc, acc_ver, taxid, gi FROM scanned_map",
        "accession_rejects": """SELECT
  CASE o_orderkey % 7
    WHEN 2 THEN concat_ws(chr(9), 'BT_' || o_orderkey, 'BT_' || o_orderkey || '.1', 'none', '1')
    WHEN 3 THEN concat_ws(chr(9), 'SH_' || o_orderkey, 'SH_' || o_orderkey || '.1', '7')
    WHEN 4 THEN concat_ws(chr(9), 'LG_' || o_orderkey, 'LG_' || o_orderkey || '.1', '7', '1', 'extra')
    ELSE concat_ws(chr(9), 'BG_' || o_orderkey, 'BG_' || o_orderkey || '.1', '7', 'x1') END AS line,
  CASE o_orderkey % 7 WHEN 2 THEN 'bad_taxid' WHEN 5 THEN 'bad_gi' ELSE 'wrong_columns' END
    AS reject_reason
  FROM orders WHERE o_orderkey % 7 IN (2, 3, 4, 5)""",
        "tree_scan": """SELECT taxid, name, parent, rank FROM tree
  UNION ALL SELECT 2000000000 + o_orderkey, '', CAST(1 AS BIGINT), 'species'
    FROM orders WHERE o_orderkey % 5 = 0""",
        "tree_rejects": """SELECT
  CASE o_orderkey % 5 WHEN 1 THEN o_orderkey || 'x,broken id,1,species'
    WHEN 2 THEN (2000000000 + o_orderkey) || ',nine,1,species,extra'
    WHEN 3 THEN (2000000000 + o_orderkey) || ',lost parent,none,species'
    ELSE (2000000000 + o_orderkey) || ',short' END AS line,
  CASE o_orderkey % 5 WHEN 1 THEN 'bad_taxid' WHEN 3 THEN 'bad_parent' ELSE 'wrong_columns' END
    AS reject_reason
  FROM orders WHERE o_orderkey % 5 <> 0""",
        "names_rejects": "SELECT line, reject_reason FROM refused_names",
        "nodes_rejects": "SELECT line, reject_reason FROM refused_nodes",
        "hash_rejects": """SELECT 'OR_' || o_orderkey || chr(9) || '1' AS line,
  'wrong_columns' AS reject_reason FROM orders""",
        "settled_accessions": "SELECT acc, acc_ver, taxid, gi FROM scanned_map",
        "line_verdicts": """SELECT 'accessions' AS file, 'kept' AS verdict, count(*) AS n FROM scanned_map
  UNION ALL SELECT 'accessions', CASE o_orderkey % 7 WHEN 2 THEN 'bad_taxid' WHEN 5 THEN 'bad_gi'
    ELSE 'wrong_columns' END AS why, count(*) FROM orders WHERE o_orderkey % 7 IN (2, 3, 4, 5) GROUP BY why
  UNION ALL SELECT 'tree', 'kept', (SELECT count(*) FROM tree) + (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0)
  UNION ALL SELECT 'tree', CASE o_orderkey % 5 WHEN 1 THEN 'bad_taxid' WHEN 3 THEN 'bad_parent'
    ELSE 'wrong_columns' END AS why, count(*) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY why
  UNION ALL SELECT 'names', 'kept', count(*) + count_if(taxid % 3 = 0) + count_if(taxid % 7 = 0) FROM tree
  UNION ALL SELECT 'names', reject_reason, count(*) FROM refused_names GROUP BY reject_reason
  UNION ALL SELECT 'nodes', 'kept', count_if(taxid % 19 <> 0) + count_if(taxid % 19 <> 0 AND taxid % 29 = 0) FROM tree
  UNION ALL SELECT 'nodes', reject_reason, count(*) FROM refused_nodes GROUP BY reject_reason
  UNION ALL SELECT 'hashes', 'kept', count(*) FROM acc_taxid
  UNION ALL SELECT 'hashes', 'wrong_columns', count(*) FROM orders""",
        "tree_parquet": "SELECT taxid, name, parent, rank FROM tree",
        "hit_file_scan": "SELECT line, acc_ver, reject_reason FROM parsed",
        "build_tree": """SELECT taxid, name,
  CASE WHEN taxid % 19 = 0 THEN 0 ELSE parent END AS parent,
  CASE WHEN taxid % 19 = 0 THEN '' ELSE rank END AS rank FROM tree""",
        "parse_hits": "SELECT line, acc_ver, reject_reason FROM parsed",
        "hit_rejects": "SELECT line, reject_reason FROM parsed WHERE acc_ver IS NULL",
        "hit_counters": """SELECT count(DISTINCT acc_ver) AS unique_accessions,
  count(acc_ver) AS accepted_rows, count(*) - count(acc_ver) AS rejected_rows FROM parsed""",
        "accession_frequency": "SELECT acc_ver, freq FROM freq",
        "taxid_by_accver": "SELECT acc_ver, freq, taxid FROM resolved",
        "accver_by_taxid": """SELECT DISTINCT m.taxid, m.acc_ver
  FROM acc_taxid m JOIN ids i ON i.taxid = m.taxid""",
        "taxid_by_name": """SELECT name, coalesce(taxid, -1) AS taxid
  FROM (SELECT a.name, g.taxid, row_number() OVER (PARTITION BY a.name ORDER BY g.taxid) AS n
        FROM asked a LEFT JOIN grouped g ON g.name = a.name) WHERE n <= 2""",
        "node_by_taxid": """SELECT i.taxid, coalesce(t.name, 'unknown') AS name,
  coalesce(t.parent, -1) AS parent, coalesce(t.rank, 'no rank') AS rank
  FROM ids i LEFT JOIN tree t ON t.taxid = i.taxid""",
        "node_by_name": """SELECT f.name, f.taxid, coalesce(t.rank, 'no rank') AS rank,
  coalesce(t.parent, -1) AS parent FROM first_named f LEFT JOIN tree t ON t.taxid = f.taxid""",
        "children_by_taxid": """SELECT i.taxid, t.taxid AS child
  FROM ids i JOIN tree t ON t.parent = i.taxid""",
        "children_by_taxid_limit": """SELECT taxid, child
  FROM (SELECT i.taxid, t.taxid AS child,
          row_number() OVER (PARTITION BY i.taxid ORDER BY t.taxid) AS n
        FROM ids i JOIN tree t ON t.parent = i.taxid) WHERE n <= 2""",
        "children_by_name": """SELECT f.name, f.taxid, t.taxid AS child
  FROM first_named f JOIN tree t ON t.parent = f.taxid WHERE f.taxid <> -1""",
        "rank_by_accver": """SELECT r.acc_ver, r.freq, r.taxid, coalesce(t.rank, 'no rank') AS rank
  FROM resolved r LEFT JOIN tree t ON t.taxid = r.taxid""",
        "ancestor_at_rank": """SELECT i.taxid, l.rk AS rank_level, coalesce(a.anc, -1) AS ancestor,
  coalesce(a.status, 'unresolved') AS status
  FROM ids i CROSS JOIN ladder l LEFT JOIN anc a ON a.seed = i.taxid AND a.rk = l.rk""",
        "rank_name_by_taxid": """SELECT b.taxid, b.rk AS rank_level, b.label AS rank_name
  FROM labels b JOIN ids i ON i.taxid = b.taxid""",
        "rank_name_by_accver": """SELECT r.acc_ver, r.taxid, b.rk AS rank_level,
  b.label AS rank_name FROM resolved r JOIN labels b ON b.taxid = r.taxid""",
        "lineage_trace": """SELECT i.taxid, s.depth, s.step_taxid, s.rank, s.name, s.status
  FROM ids i JOIN steps s ON s.seed = i.taxid""",
        "lineage_by_accver": """SELECT r.acc_ver, r.taxid, s.depth, s.step_taxid, s.rank, s.name,
  s.status FROM resolved r JOIN steps s ON s.seed = r.taxid""",
        "lineage_path": """SELECT i.taxid,
  string_agg(CAST(s.step_taxid AS VARCHAR), '/' ORDER BY s.depth DESC) AS path,
  any_value(s.status) AS status FROM ids i JOIN steps s ON s.seed = i.taxid GROUP BY i.taxid""",
        "descendants": "SELECT taxid, descendant FROM pairs",
        "descendant_accessions": """SELECT DISTINCT p.taxid, m.acc_ver
  FROM (SELECT taxid, descendant FROM pairs UNION ALL SELECT taxid, taxid FROM ids) p
  JOIN acc_taxid m ON m.taxid = p.descendant""",
        "parent_hops": f"""SELECT {_HOPS} FROM tree h0
  JOIN tree h1 ON h1.taxid = h0.parent JOIN tree h2 ON h2.taxid = h1.parent
  JOIN tree h3 ON h3.taxid = h2.parent""",
        "nth_parent": """SELECT i.taxid, coalesce(w.taxid, p.top) AS ancestor
  FROM ids i LEFT JOIN tip p ON p.seed = i.taxid LEFT JOIN walk w ON w.seed = i.taxid AND w.depth = 5""",
        "subtree_accessions": """SELECT DISTINCT CAST(2003 AS BIGINT) AS taxid, m.acc_ver
  FROM acc_taxid m JOIN (SELECT descendant FROM pairs WHERE taxid = 2003 UNION ALL SELECT 2003) d
    ON m.taxid = d.descendant""",
        "distinct_taxids": "SELECT DISTINCT taxid FROM acc_taxid",
        "accessions_per_taxid": "SELECT taxid, count(*) AS count FROM acc_taxid GROUP BY taxid",
        "seed_join": """SELECT taxid, name, parent, rank FROM tree
  WHERE taxid IN (SELECT taxid FROM acc_taxid)""",
        "trace_table": "SELECT * FROM trace",
        "trace_table_direct": """SELECT t.taxid, t.name, t.parent, t.rank,
  s.anc AS species_taxid, coalesce(n1.name, 'unknown') AS species_name,
  g.anc AS genus_taxid, coalesce(n2.name, 'unknown') AS genus_name,
  f.anc AS family_taxid, coalesce(n3.name, 'unknown') AS family_name,
  k.anc AS superkingdom_taxid, coalesce(n4.name, 'unknown') AS superkingdom_name
  FROM tree t JOIN anc s ON s.seed = t.taxid AND s.rk = 'species'
  JOIN anc g ON g.seed = t.taxid AND g.rk = 'genus'
  JOIN anc f ON f.seed = t.taxid AND f.rk = 'family'
  JOIN anc k ON k.seed = t.taxid AND k.rk = 'superkingdom'
  LEFT JOIN tree n1 ON n1.taxid = s.anc LEFT JOIN tree n2 ON n2.taxid = g.anc
  LEFT JOIN tree n3 ON n3.taxid = f.anc LEFT JOIN tree n4 ON n4.taxid = k.anc
  WHERE t.taxid IN (SELECT taxid FROM acc_taxid)""",
        "trace_filter": "SELECT * FROM trace WHERE rank = 'species'",
        "trace_filter_not": "SELECT * FROM trace WHERE rank <> 'species'",
        "trace_point": "SELECT * FROM trace WHERE taxid = 1000000001",
        "trace_species_parquet": "SELECT * FROM trace WHERE rank = 'species'",
        "trace_store_filter": "SELECT * FROM trace WHERE rank = 'species'",
        "trace_store_point": "SELECT * FROM trace WHERE taxid = 1000000001",
        "trace_view_sql": """SELECT rank, species_taxid, count(taxid) AS n FROM trace
  GROUP BY rank, species_taxid""",
        "accession_stores": "SELECT acc_ver, freq, taxid, taxid AS bucketed_taxid FROM resolved",
        "key_hash": """SELECT {h1} AS acc_hash, {h2} AS acc_ver_hash, taxid FROM acc_taxid""".format(
            h1=_signed("acc"), h2=_signed("acc_ver")
        ),
        "trace_counts": """SELECT count(taxid) AS all_rows,
  count(*) FILTER (WHERE rank = 'species') AS species_rows,
  count(*) FILTER (WHERE rank = 'no rank') AS no_rank_rows FROM trace""",
        "table_counts": """SELECT 'acc_taxid' AS table_name, count(*) AS n_rows FROM acc_taxid
  UNION ALL SELECT 'distinct_taxids', count(DISTINCT taxid) FROM acc_taxid
  UNION ALL SELECT 'tree', count(*) FROM tree UNION ALL SELECT 'hits', count(*) FROM hits""",
        "annotate_hits": """SELECT r.acc_ver, r.freq, r.taxid, t.name, t.parent, t.rank,
  t.species_taxid, t.species_name, t.genus_taxid, t.genus_name, t.family_taxid, t.family_name,
  t.superkingdom_taxid, t.superkingdom_name
  FROM resolved r LEFT JOIN trace t ON t.taxid = r.taxid""",
        "annotate_hits_stored": """SELECT r.acc_ver, r.freq, r.taxid, t.name, t.parent, t.rank,
  t.species_taxid, t.species_name, t.genus_taxid, t.genus_name, t.family_taxid, t.family_name,
  t.superkingdom_taxid, t.superkingdom_name
  FROM resolved r LEFT JOIN trace t ON t.taxid = r.taxid""",
        "taxid_tally": "SELECT taxid, tally, n_children FROM tally",
        "rank_rollup": """SELECT rank_level, taxid, parent_taxid, rank_name, mapped_rank, tally,
  n_children FROM rollup_rows""",
        "rollup_children": """SELECT 'subspecies' AS rank_level, taxid, acc_ver AS child FROM resolved
  UNION ALL SELECT 'species', up, CAST(taxid AS VARCHAR) FROM lv0
  UNION ALL SELECT 'genus', up, CAST(taxid AS VARCHAR) FROM lv1
  UNION ALL SELECT 'family', up, CAST(taxid AS VARCHAR) FROM lv2
  UNION ALL SELECT 'superkingdom', up, CAST(taxid AS VARCHAR) FROM lv3""",
        "report": """SELECT rank_level, taxid, rank_name, mapped_rank, tally, percentage,
  running_tally, line_no FROM ranked""",
        "report_lines": _LINES,
        "report_file": f"SELECT line, count(*) AS n FROM ({_LINES}) GROUP BY line",
        "report_html_rows": f"""SELECT rank_level, line_no,
  printf('{_HTML_ROW}', tally, percentage, display, taxid, taxid_text) AS html FROM shown""",
        "report_summary": f"""SELECT line_no, '<TR><TD>' || title || '</TD><TD>' || shown
    || '</TD></TR>' AS html
  FROM (SELECT CAST(1 AS BIGINT) AS line_no, '{_SUMMARY_TITLES[0]}' AS title, 'sales' AS shown
    UNION ALL SELECT 2, '{_SUMMARY_TITLES[1]}', 'orders as taxa'
    UNION ALL SELECT 3, '{_SUMMARY_TITLES[2]}', CAST(count(DISTINCT acc_ver) AS VARCHAR) FROM parsed
    UNION ALL SELECT 4, '{_SUMMARY_TITLES[3]}', format('{{:,}}', count(acc_ver)) FROM parsed
    UNION ALL SELECT 5, '{_SUMMARY_TITLES[4]}', CAST(count(*) - count(acc_ver) AS VARCHAR)
      FROM parsed)""",
        "key_collisions": """SELECT acc_ver, count(*) AS n_rows FROM acc_taxid
  GROUP BY acc_ver HAVING count(*) > 1""",
        "first_accessions": """SELECT acc, acc_ver, taxid, gi FROM (
    SELECT *, row_number() OVER (PARTITION BY acc_ver ORDER BY gi, acc, taxid) AS place FROM (
      SELECT acc, acc_ver, taxid, gi FROM acc_taxid
      UNION ALL SELECT acc, acc_ver, taxid + gi % 3 - 1, gi - gi % 2 FROM acc_taxid WHERE gi % 30 < 3))
  WHERE place = 1""",
    }.items()
}
