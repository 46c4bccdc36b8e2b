"""Schemas, the rank ladder and the fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

ACCESSION_MAP = T.StructType(
    [
        T.StructField("acc", T.StringType()),
        T.StructField("acc_ver", T.StringType()),
        T.StructField("taxid", T.LongType()),
        T.StructField("gi", T.LongType()),
    ]
)

TREE = T.StructType(
    [
        T.StructField("taxid", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("parent", T.LongType()),
        T.StructField("rank", T.StringType()),
    ]
)

# The ranks reported above the accession level, lowest first.
RANKS = ("species", "genus", "family", "superkingdom")
# Fixed value: name of the accession level, which holds taxids of any rank.
ACCESSION_LEVEL = "subspecies"
LEVELS = (ACCESSION_LEVEL, *RANKS)

# Identifiers and texts that stand for "no answer".
ROOT = 1
UNKNOWN_ID = -1
NO_RANK = "no rank"
UNKNOWN_NAME = "unknown"
ROOT_LABEL = "Taxonomy_Tree_Root"
INVALID_LABEL = "Invalid_TaxID"

# How a climb towards a rank ended.
FOUND = "found"
TOP = "top"
UNRESOLVED = "unresolved"
CYCLE = "cycle"

# Column that a trace store is partitioned by, and the mark in front of the rank in it.
RANK_FOLDER, RANK_MARK = "rank_folder", "r:"
