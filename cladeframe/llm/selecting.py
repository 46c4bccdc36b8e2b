"""Pick out, or add to, the documents that a list of ids names, without moving other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ids, of eight bytes each, up to which a list is sent to every executor.
SENT_IDS = 1 << 20


def _sent(ids: DataFrame) -> DataFrame:
    """`ids` (a staged table of one number column), to be broadcast if its counted size allows."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def named(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is in `ids` (staged, column doc_id)."""
    return docs.join(_sent(ids), "doc_id", "left_semi")


def unnamed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in `ids`, those without one included."""
    return docs.join(_sent(ids), "doc_id", "left_anti")


def beside(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """Left join of documents with `extra` (staged, one row per doc_id).

    Where the ids of `extra` are few enough to be sent, all other texts stay in place.
    """
    ids = extra.select("doc_id")
    if ids.count() > SENT_IDS:
        return docs.join(extra, "doc_id", "left")
    ids = F.broadcast(ids)
    rest = docs.join(ids, "doc_id", "left_anti")
    for field in extra.schema.fields:
        if field.name != "doc_id":
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    found = docs.join(ids, "doc_id", "left_semi").join(extra, "doc_id")
    return found.select(rest.columns).unionByName(rest)
