"""Ancestors, lineages, paths, children and descendants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladder
from ..schemas import (
    CYCLE,
    FOUND,
    INVALID_LABEL,
    NO_RANK,
    RANKS,
    ROOT,
    ROOT_LABEL,
    UNKNOWN_ID,
    UNKNOWN_NAME,
    UNRESOLVED,
)
from .climb import Stretch, climb, node_parts, prepared
from .intervals import number, spread
from .joins import first_k, has_hot_key, lookup, spread_lookup
from .staging import counted, derived, part_of, sized, stage, within_broadcast


class Taxonomy:
    """A tree prepared for lineage questions; closures are built once, on first use.

    `everything` has one row per taxid or parent: taxid, name, parent, rank, is_parent, known.
    `nodes` are the known ones: taxid, name, parent, rank, is_parent.
    """

    def __init__(self, tree: DataFrame):
        self.everything = prepared(tree)
        known = part_of(self.everything, "known", F.col("known"))
        self.nodes = derived(known.drop("known"), known)
        self._answers: dict[tuple, DataFrame] = {}
        self._names: dict[tuple, dict[str, DataFrame]] = {}
        self._paths: DataFrame | None = None
        self._intervals: DataFrame | None = None
        self._jumps: list[DataFrame] = []

    def inner(self) -> DataFrame:
        """Nodes that are somebody's parent."""
        return part_of(self.everything, "inner", F.col("known") & F.col("is_parent")).drop("known")

    def answers(self, ranks: Sequence[str], mode: str = ladder.DIRECT) -> DataFrame:
        """Every node with the ancestor-or-self found at each rank: taxid, found_1.., top, gap, status."""
        key = (tuple(r.lower() for r in ranks), mode)
        if key not in self._answers:
            own, joined = ladder.stretch_fields(ranks, mode)
            # From each rank's answer to the next, a cycle may have to be passed again.
            closed = climb(self.everything, Stretch(own, joined), len(ranks))
            found = closed.select("taxid", *ladder.found_ids(ranks, mode), "top", "gap", "status")
            self._answers[key] = derived(found, closed)
        return self._answers[key]

    def names(self, ranks: Sequence[str]) -> dict[int, DataFrame]:
        """For each rank, from 1, the names of its nodes (_id, _name), and under 0 those of all tops."""
        key = tuple(r.lower() for r in ranks)
        if key not in self._names:
            level = F.coalesce(ladder.level_of(ranks), F.lit(0))
            is_top = F.col("taxid") == F.col("parent")
            listed = self.nodes.select(
                "taxid",
                "name",
                is_top.alias("is_top"),
                F.explode(F.array_distinct(F.array(level, F.when(is_top, 0).otherwise(level)))).alias("level"),
            ).where("level > 0 OR is_top")
            levels = range(len(ranks) + 1)
            conditions = {str(k): F.col("level") == k for k in levels}
            table = stage(listed.drop("is_top"), parts=conditions, by="level")
            found = {}
            for k in levels:
                own = part_of(table, str(k), F.col("level") == k)
                found[k] = derived(own.select(F.col("taxid").alias("_id"), F.col("name").alias("_name")), own)
            self._names[key] = found
        return self._names[key]

    def paths(self) -> DataFrame:
        """Every node with `path`, the taxids from itself to the end of its chain.

        A chain that runs into a cycle ends before the first taxid it would repeat.
        """
        if self._paths is None:
            empty = F.slice("path", 1, 0)
            along = Stretch(
                {"path": F.array("taxid")}, {"path": F.concat("path", F.coalesce(F.col("_path"), empty))}
            )
            distinct = F.size(F.array_distinct("path"))
            closed = climb(self.everything, along, covered=distinct)
            path = F.when(F.col("status") == CYCLE, F.slice("path", F.lit(1), distinct)).otherwise(F.col("path"))
            self._paths = derived(closed.withColumn("path", path), closed)
            self._paths._has_cycles = closed._has_cycles
        return self._paths

    def intervals(self) -> DataFrame:
        """Numbered nodes and missing parents: taxid, entry, size; none on or below a cycle."""
        if self._intervals is None:
            self._intervals = number(self.everything)
        return self._intervals

    def jump(self, power: int) -> DataFrame:
        """Parents with their ancestor 2^power levels up, a top being its own: _id, _up.

        A row is missing where the chain breaks within that range. Each table is made from the one
        before and kept.
        """
        if not self._jumps:
            inner = part_of(self.everything, "inner", F.col("known") & F.col("is_parent"))
            self._jumps.append(stage(inner.select(F.col("taxid").alias("_id"), F.col("parent").alias("_up"))))
        while len(self._jumps) <= power:
            last = self._jumps[-1]
            ahead = derived(last.select(F.col("_id").alias("_at"), F.col("_up").alias("_next")), last)
            further = lookup(last, ahead, "_up", "_at", "inner", staged=True)
            self._jumps.append(stage(further.select("_id", F.col("_next").alias("_up"))))
        return self._jumps[power]


def as_taxonomy(tree: DataFrame | Taxonomy) -> Taxonomy:
    """Accept a raw tree or one that is prepared already."""
    return tree if isinstance(tree, Taxonomy) else Taxonomy(tree)


def _keyed(dim: DataFrame) -> DataFrame:
    """Rename the key of a lookup table so that it does not clash with the facts'."""
    return derived(dim.withColumnRenamed("taxid", "_id"), dim)


def with_answers(keys: DataFrame, tree: Taxonomy, ranks: Sequence[str], mode: str = ladder.DIRECT) -> DataFrame:
    """Keys (with taxid) beside found_1.., top, gap and status; null for ids not in the tree."""
    return lookup(keys, _keyed(tree.answers(ranks, mode)), "taxid", "_id").drop("_id")


def _place_of(k: int) -> tuple[str, str]:
    """Columns of the id found at the k-th rank, or for 0 at the top, and of its name."""
    return ("top", "top_name") if k == 0 else (f"found_{k}", f"name_{k}")


def with_names(found: DataFrame, tree: Taxonomy, ranks: Sequence[str], places: Sequence[int]) -> DataFrame:
    """Names of what was found at the ranks in `places`, as name_<k>; 0 stands for the top, as top_name."""
    names = tree.names(ranks)
    large = [k for k in places if not within_broadcast(names[k])]
    if large:
        # Written once, as ids; only where a key is hot are rows with names written again.
        found = stage(found)
    hot = {k for k in large if has_hot_key(found, _place_of(k)[0])}
    for k in sorted(places, key=lambda k: (k not in hot, k)):
        key, name = _place_of(k)
        columns = found.columns
        met = spread_lookup(found, names[k], key, "_id") if k in large and k not in hot else lookup(found, names[k], key, "_id")
        found = met.select(*columns, F.col("_name").alias(name))
    return found


def _distinct(ranks: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """The ranks as asked for, and each once in small letters."""
    ranks = [ranks] if isinstance(ranks, str) else list(ranks)
    return ranks, list(dict.fromkeys(r.lower() for r in ranks))


def ancestor_at_rank(
    keys: DataFrame, tree: DataFrame | Taxonomy, ranks: str | Sequence[str]
) -> DataFrame:
    """Nearest ancestor-or-self at each rank: keys' columns, rank_level, ancestor, status.

    `keys` has a column taxid. Where no such ancestor exists, the answer is the top
    of the chain, or -1 if the chain breaks off or runs in a circle.
    """
    ranks, asked = _distinct(ranks)
    found = with_answers(keys, as_taxonomy(tree), asked)
    ended = F.coalesce("status", F.lit(UNRESOLVED))
    answers = []
    for rank in ranks:
        k = asked.index(rank.lower()) + 1
        is_found = F.col(f"found_{k}").isNotNull()
        answer, status = ladder.answer_id(k), F.when(is_found, FOUND).otherwise(ended)
        if rank.lower() == NO_RANK:
            # An id missing from the tree counts as a node without rank.
            missing = F.when(F.col("status").isNull(), F.col("taxid")).otherwise(F.col("gap"))
            unranked = ~is_found & missing.isNotNull()
            answer = F.when(unranked, missing).otherwise(answer)
            status = F.when(unranked, FOUND).otherwise(status)
        answers.append(
            F.struct(
                F.lit(rank).alias("rank_level"), answer.alias("ancestor"), status.alias("status")
            )
        )
    return found.select(*keys.columns, F.inline(F.array(*answers)))


def rank_name(
    keys: DataFrame, tree: DataFrame | Taxonomy, ranks: str | Sequence[str]
) -> DataFrame:
    """Name of the nearest ancestor-or-self at each rank: keys' columns, rank_level, rank_name.

    Chains that end at the root read Taxonomy_Tree_Root, all others without an
    answer Invalid_TaxID.
    """
    ranks, asked = _distinct(ranks)
    tree = as_taxonomy(tree)
    found = with_names(with_answers(keys, tree, asked), tree, asked, range(1, len(asked) + 1))
    answers = []
    for rank in ranks:
        k = asked.index(rank.lower()) + 1
        is_found = F.col(f"found_{k}").isNotNull()
        climbed_to_root = (ladder.answer_id(k) == ROOT) & (F.col("taxid") != ROOT)
        label = (
            F.when(~is_found & (F.col("gap") == ROOT), F.lit(ROOT_LABEL))
            .when(is_found & climbed_to_root, F.lit(ROOT_LABEL))
            .otherwise(ladder.answer_label(k))
        )
        if rank.lower() == NO_RANK:
            nameless = ~is_found & (F.col("gap").isNotNull() | F.col("status").isNull())
            label = F.when(
                nameless & (F.coalesce("gap", F.lit(UNKNOWN_ID)) != ROOT), F.lit(UNKNOWN_NAME)
            ).otherwise(label)
        answers.append(F.struct(F.lit(rank).alias("rank_level"), label.alias("rank_name")))
    return found.select(*keys.columns, F.inline(F.array(*answers)))


def _full_paths(keys: DataFrame, tree: Taxonomy, *columns: str) -> DataFrame:
    """keys' columns, path from the key upwards, status; broken chains end in (missing, -1).

    `columns` of the key's own node come along as _<column>.
    """
    closed = tree.paths()
    known = counted(closed)
    if columns:
        own = tree.nodes.select("taxid", *[F.col(c).alias(f"_{c}") for c in columns])
        closed = sized(closed.join(own, "taxid"), known + counted(tree.nodes))
    found = lookup(keys, _keyed(closed), "taxid", "_id")
    unknown = F.lit(UNKNOWN_ID).cast("bigint")
    path = (
        F.when(F.col("taxid") == UNKNOWN_ID, F.array(unknown))
        .when(F.col("_id").isNull(), F.array(F.col("taxid"), unknown))
        .when(F.col("gap") == UNKNOWN_ID, F.concat("path", F.array(unknown)))
        .when(F.col("gap").isNotNull(), F.concat("path", F.array(F.col("gap"), unknown)))
        .otherwise(F.col("path"))
    )
    return found.select(
        *keys.columns,
        path.alias("path"),
        F.coalesce("status", F.lit(UNRESOLVED)).alias("status"),
        *[f"_{c}" for c in columns],
    )


def lineage(keys: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Full lineage, leaf to root, one row per step.

    Keys' columns (with taxid), depth from 0, step_taxid, rank, name, status. The key's own
    rank and name come with its path; all further steps are parents, of which a tree has few.
    """
    tree = as_taxonomy(tree)
    steps = _full_paths(keys, tree, "rank", "name").select(
        *keys.columns,
        "status",
        F.posexplode("path").alias("depth", "step_taxid"),
        F.col("_rank").alias("_own_rank"),
        F.col("_name").alias("_own_name"),
    )
    first = F.col("depth") == 0
    steps = steps.select(
        *keys.columns,
        "status",
        "depth",
        "step_taxid",
        F.when(first, F.col("_own_rank")).alias("_own_rank"),
        F.when(first, F.col("_own_name")).alias("_own_name"),
        F.when(~first, F.col("step_taxid")).alias("_step"),
    )
    inner = part_of(tree.everything, "inner", F.col("known") & F.col("is_parent"))
    parents = derived(
        inner.select(
            F.col("taxid").alias("_id"), F.col("rank").alias("_rank"), F.col("name").alias("_name")
        ),
        inner,
    )
    return lookup(steps, parents, "_step", "_id").select(
        *keys.columns,
        "depth",
        "step_taxid",
        F.coalesce("_rank", "_own_rank", F.lit(NO_RANK)).alias("rank"),
        F.coalesce("_name", "_own_name", F.lit(UNKNOWN_NAME)).alias("name"),
        "status",
    )


def paths(keys: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """Path of ids from the root to each key: keys' columns, path ARRAY<BIGINT>, status."""
    return _full_paths(keys, as_taxonomy(tree)).withColumn("path", F.reverse("path"))


def children(
    keys: DataFrame, tree: DataFrame | Taxonomy, limit: int | None = None
) -> DataFrame:
    """Direct children of each distinct key: taxid, child. A self-parent is its own child.

    `limit` keeps the smallest ids per key, as asked by the caller.
    """
    wanted = stage(keys.select(F.col("taxid")).distinct())
    nodes = as_taxonomy(tree).nodes.select(F.col("taxid").alias("child"), "parent")
    found = lookup(nodes, wanted, "parent", "taxid", "inner", staged=True).select("taxid", "child")
    return found if limit is None else first_k(found, "taxid", "child", limit)


def descendants(keys: DataFrame, tree: DataFrame | Taxonomy) -> DataFrame:
    """All nodes below each distinct key, the key itself excluded: taxid, descendant.

    A key's descendants are a range of entry numbers; the range is written out and every number
    met with its node, so there are never more rows than answers. No number is asked for by
    more rows than its chain has keys. Cycles have no ranges; nodes there list their own ancestors.
    """
    tree = as_taxonomy(tree)
    wanted = stage(keys.select("taxid").distinct())
    numbered = tree.intervals()
    own = derived(numbered.withColumnRenamed("taxid", "_id"), numbered)
    ranges = lookup(wanted, own, "taxid", "_id", "inner", staged=True).select(
        "taxid", (F.col("entry") + 1).alias("_first"), (F.col("size") - 1).alias("_size")
    )
    asked = spread(ranges, "_first", "_size", "_at")
    nodes = numbered.select(F.col("entry").alias("_entry"), F.col("taxid").alias("descendant"))
    nodes = F.broadcast(nodes) if within_broadcast(numbered) else nodes.hint("merge")
    found = asked.join(nodes, F.col("_at") == F.col("_entry")).select("taxid", "descendant")
    if not numbered._has_cycles:
        return found
    circling = tree.paths().where(F.col("status") == CYCLE)
    pairs = stage(
        circling.select(
            F.col("taxid").alias("descendant"), F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("_above")
        )
    )
    return found.unionByName(lookup(pairs, wanted, "_above", "taxid", "inner", staged=True).select("taxid", "descendant"))


def descendant_accessions(
    keys: DataFrame, tree: DataFrame | Taxonomy, acc_map: DataFrame
) -> DataFrame:
    """All accessions mapped to each distinct key or to anything below it: taxid, acc_ver.

    A climb gives every node the keys above it, so neither ranges nor pairs of nodes are written out.
    The map is read once. Only accessions with several taxids can give a pair twice, and only
    those are compared.
    """
    above = owners(keys, as_taxonomy(tree))
    several = F.count_if(~F.col("_mapped").eqNullSafe(F.col("_other")))
    mapped = acc_map.select("acc_ver", F.col("taxid").alias("_mapped"))
    per_key = stage(
        mapped.groupBy("acc_ver").agg(F.min("_mapped").alias("_mapped"), F.max("_mapped").alias("_other")),
        several=several,
    )
    is_single = F.col("_mapped").eqNullSafe(F.col("_other"))
    single = derived(per_key.where(is_single).select("acc_ver", "_mapped"), per_key)

    def owned(rows: DataFrame) -> DataFrame:
        found = lookup(rows, above, "_mapped", "_id", "inner", staged=True)
        return found.select(F.explode("owners").alias("taxid"), "acc_ver")

    if not counted(per_key).measures["several"]:
        return owned(single)
    again = stage(mapped.join(per_key.where(~is_single).select("acc_ver"), "acc_ver", "left_semi").distinct())
    return owned(single).unionByName(owned(again).distinct())


def owners(keys: DataFrame, tree: Taxonomy) -> DataFrame:
    """Ids with the distinct keys that are themselves or above them: _id, owners; ids without any may be left out.

    Keys that the tree does not know own themselves and what breaks off below them. A list is no longer
    than a chain has keys; nodes that are nobody's parent get theirs by one join at the end.
    """
    everything = tree.everything
    wanted = keys.select(F.col("taxid").alias("_key")).where("_key is not null").distinct()
    # Both sides have one row per id. Ids missing from the tree stand as tops of their own.
    known = F.coalesce("known", F.lit(False))
    flagged = everything.select("taxid", "parent", "is_parent", "known").join(
        wanted, F.col("taxid") == F.col("_key"), "full_outer"
    )
    taxid = F.coalesce("taxid", "_key")
    nodes = stage(
        flagged.select(
            taxid.alias("taxid"),
            F.when(known, F.col("parent")).otherwise(taxid).alias("parent"),
            F.coalesce("is_parent", F.lit(False)).alias("is_parent"),
            F.lit(True).alias("known"),
            F.col("_key").isNotNull().alias("wanted"),
        ),
        parts=node_parts(),
    )
    none = F.array().cast("array<bigint>")
    along = Stretch(
        {"owners": F.when(F.col("wanted"), F.array("taxid")).otherwise(none)},
        {"owners": F.array_union("owners", F.coalesce(F.col("_owners"), none))},
    )
    closed = climb(nodes, along)
    return derived(closed.where(F.size("owners") > 0).select(F.col("taxid").alias("_id"), "owners"), closed)


def nth_parent(keys: DataFrame, tree: DataFrame | Taxonomy, n: int) -> DataFrame:
    """The ancestor `n` levels up: keys' columns, ancestor.

    A top is its own parent; null where the chain breaks within that range. One join for
    each binary digit of n that is set, with stored tables of jumps.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    tree = as_taxonomy(tree)
    parents = derived(tree.nodes.select(F.col("taxid").alias("_id"), F.col("parent").alias("_up")), tree.nodes)
    found = lookup(keys, parents, "taxid", "_id").withColumn(
        "ancestor", F.when(F.col("_id").isNotNull(), F.col("taxid" if n == 0 else "_up"))
    )
    found = found.select(*keys.columns, "ancestor")
    if n == 0:
        return found
    for power in range((n - 1).bit_length()):
        if (n - 1) >> power & 1:
            found = lookup(found, tree.jump(power), "ancestor", "_id").select(
                *keys.columns, F.col("_up").alias("ancestor")
            )
    # The last id reached may be one that is missing from the tree.
    inner = part_of(tree.everything, "inner", F.col("known") & F.col("is_parent"))
    there = derived(inner.select(F.col("taxid").alias("_id")), inner)
    return lookup(found, there, "ancestor", "_id").select(*keys.columns, F.col("_id").alias("ancestor"))


def parent_hops(tree: DataFrame | Taxonomy, hops: int) -> DataFrame:
    """Each node beside its parent, grandparent, ... up to `hops` levels.

    Columns taxid_t<i>, name_t<i>, parent_t<i>, rank_t<i> for i = 0..hops. A node
    whose chain has a missing parent within that range drops out. Chains of 1, 2, 4, ... parents
    are put together by the binary digits of `hops`, so joins grow with its logarithm.
    """
    tree = as_taxonomy(tree)
    columns = ("taxid", "name", "parent", "rank")
    chain = F.array(F.struct(*columns)).alias("chain")
    found = tree.nodes.select(chain, F.col("parent").alias("_next"))
    inner = part_of(tree.everything, "inner", F.col("known") & F.col("is_parent"))
    power = derived(inner.select(F.col("taxid").alias("_id"), chain.alias("_chain"), F.col("parent").alias("_on")), inner)
    known = counted(tree.nodes)
    levels = range(hops + 1)
    while hops:
        if hops & 1:
            joined = lookup(sized(found, known), power, "_next", "_id", "inner", staged=known is not None)
            found, known = joined.select(F.concat("chain", "_chain").alias("chain"), F.col("_on").alias("_next")), None
        hops >>= 1
        if hops:
            again = power.select(F.col("_id").alias("_from"), F.col("_chain").alias("_begin"), F.col("_on").alias("_to"))
            doubled = lookup(derived(again, power), power, "_to", "_id", "inner", staged=True)
            power = stage(doubled.select(F.col("_from").alias("_id"), F.concat("_begin", "_chain").alias("_chain"), "_on"))
    return found.select(*[F.col("chain")[i][c].alias(f"{c}_t{i}") for i in levels for c in columns])
