"""Hashed keys and key checks for accession maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import repeated_keys


def _hash64(text: str) -> Column:
    """The first 64 bits of a text's MD5, as a signed number; other engines can compute it."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")


def key_hash(acc_map: DataFrame) -> DataFrame:
    """64-bit hashes in place of the text keys: acc_hash, acc_ver_hash, taxid."""
    return acc_map.select(
        _hash64("acc").alias("acc_hash"), _hash64("acc_ver").alias("acc_ver_hash"), "taxid"
    )


def key_collisions(acc_map: DataFrame, key: str = "acc_ver") -> DataFrame:
    """Key values that occur more than once: the key, n_rows. Only keys that may repeat are shuffled."""
    return repeated_keys(acc_map, key)
