"""Ancestors at ranks: what a climb carries to find them, and how answers are read off.

A chain is walked looking for ranks in order. The direct way looks for every rank from the
node itself and keeps one id a rank. The cascade looks for the first rank, then for the
next one from its answer on, and so forth; what a stretch of chain does to that depends only on the
rank it starts looking for, so a stretch keeps, for every first rank, the ids found until the stretch
ends: r (r + 1) / 2 ids for r ranks, however long the stretch is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INVALID_LABEL, ROOT, ROOT_LABEL, UNKNOWN_ID, UNKNOWN_NAME

CASCADE = "cascade"
DIRECT = "direct"


def level_of(ranks: Sequence[str]) -> Column:
    """Place of a node's rank among the ranks asked for, from 1; null for any other."""
    level = F.lit(None).cast("int")
    for k, rank in enumerate(ranks, 1):
        level = F.when(F.lower("rank") == rank.lower(), k).otherwise(level)
    return level


def stretch_fields(ranks: Sequence[str], mode: str) -> tuple[Mapping[str, Column], Mapping[str, Column]]:
    """A node's own fields, and those of two stretches in a row (the second's with `_` in front)."""
    if mode not in (CASCADE, DIRECT):
        raise ValueError(f"unknown mode {mode!r}")
    level, n = level_of(ranks), len(ranks)
    if mode == DIRECT:
        own = {f"found_{k}": F.when(level == k, F.col("taxid")) for k in range(1, n + 1)}
        return own, {name: F.coalesce(name, f"_{name}") for name in own}
    none = F.lit(None).cast("bigint")
    own, joined = {}, {}
    for first in range(1, n + 1):
        for k in range(first, n + 1):
            own[f"found_{first}_{k}"] = F.when(level == k, F.col("taxid")) if k == first else none
            # The second stretch goes on with the first rank that the first one did not find.
            rest = F.col(f"_found_{k}_{k}")
            for missing in range(k - 1, first - 1, -1):
                unfound = F.col(f"found_{first}_{missing}").isNull()
                rest = F.when(unfound, F.col(f"_found_{missing}_{k}")).otherwise(rest)
            joined[f"found_{first}_{k}"] = F.coalesce(F.col(f"found_{first}_{k}"), rest)
    # The top itself may carry a rank; a climb stranded there can still find it.
    own["top_level"] = F.when(F.col("taxid") == F.col("parent"), level)
    joined["top_level"] = F.coalesce("top_level", "_top_level")
    return own, joined


def found_ids(ranks: Sequence[str], mode: str) -> list[Column]:
    """The id found at each rank, as `found_<k>`; null where the climb went on to the end."""
    if mode == DIRECT:
        return [F.col(f"found_{k}") for k in range(1, len(ranks) + 1)]
    return [
        F.coalesce(F.col(f"found_1_{k}"), F.when(F.col("top_level") == k, F.col("top"))).alias(f"found_{k}")
        for k in range(1, len(ranks) + 1)
    ]


def answer_id(k: int) -> Column:
    """Taxid of the k-th rank's answer: the node, else the top, else -1."""
    return F.coalesce(f"found_{k}", "top", F.lit(UNKNOWN_ID).cast("bigint"))


def answer_name(k: int) -> Column:
    """Plain name of the k-th rank's answer, as stored in the tree."""
    return F.coalesce(F.when(F.col(f"found_{k}").isNotNull(), F.col(f"name_{k}")).otherwise(F.col("top_name")), F.lit(UNKNOWN_NAME))


def answer_label(k: int) -> Column:
    """Report label of the k-th rank's answer: its name only where the rank fits."""
    return (
        F.when(F.col(f"found_{k}").isNotNull(), F.col(f"name_{k}"))
        .when(F.col("top") == ROOT, F.lit(ROOT_LABEL))
        .otherwise(F.lit(INVALID_LABEL))
    )
