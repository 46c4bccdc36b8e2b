"""Bounded labelled samples for the classifiers, and flat views of Arrow columns."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import crc_fold

# The bounds of a training sample: rows of a class, and bytes of a text that may be in it.
# With both, a sample never exceeds a few tens of MB, whatever the corpus holds.
PER_CLASS = 1500
LONGEST_TEXT = 32_768
SEED = 11


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    per_class: int = PER_CLASS,
    longest: int = LONGEST_TEXT,
) -> tuple[dict, float]:
    """A bounded sample of learnable labelled ids, and the share of label 1 among all of them.

    Learnable are the documents whose crc32 fold is not `held_out`. Of each class the
    `per_class` ids with the smallest seeded hash are taken, each once however many rows repeat
    it; texts of more than `longest` bytes are not learned from. A document
    labelled more than once has its smallest label. Returns {doc_id: label} and
    the share.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    usable = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = pick(known.join(usable.select("doc_id"), "doc_id", "left_semi"), "label", per_class)
    n = sum(counts.values())
    return picked, counts.get(1, 0) / n if n else 0.5


def pick(rows: DataFrame, group: str, most: int) -> dict:
    """For each `group` the `most` ids with the smallest seeded hash: {doc_id: group}.

    `rows` has one row per id, and groups are few. Ids only. A cut-off that four times as many ids are
    expected to stay below keeps what is ranked small, however many tasks there are.
    """
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) / (1 << 40)
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | (F.col(group).eqNullSafe(F.lit(value)) & (share < 4 * most / n))
    ranked = (
        rows.select("doc_id", group)
        .where(keep)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(share, "doc_id")))
        .where(F.col("_rank") <= most)
    )
    return {r["doc_id"]: r[group] for r in ranked.collect()}


def one_each(docs: DataFrame, picked: dict, columns: list[str]) -> DataFrame:
    """One row for each picked id: doc_id, its group as `_class`, and the columns.

    Of rows that repeat an id the smallest (columns in order) counts; they are reduced in every task
    before anything moves. The ids are those of a bounded sample and are sent to every task.
    """
    spark = docs.sparkSession
    kind = "string" if any(isinstance(v, str) for v in picked.values()) else "int"
    ids = spark.createDataFrame(list(picked.items()), f"_id bigint, _class {kind}")
    own = docs.select("doc_id", F.struct(*columns).alias("_row"))
    named = own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return named.groupBy("doc_id", "_class").agg(F.min("_row").alias("_row")).select(
        "doc_id", "_class", *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def fitted_in_task(rows: DataFrame, fit) -> dict:
    """What `fit` makes of a bounded sample, a pandas frame, in one task; plain numbers and arrays.

    The driver gets the finished parameters only. Nothing to learn from gives {}.
    """

    def run(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            yield pd.DataFrame({"fitted": [pickle.dumps(fit(pd.concat(frames, ignore_index=True)))]})

    made = rows.repartition(1).mapInPandas(run, "fitted binary").first()
    return pickle.loads(made["fitted"]) if made else {}


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give a sample the class shares of all labelled rows."""
    have = y.mean() if len(y) else 0.5
    if have in (0.0, 1.0):
        return np.ones(len(y), np.float32)
    return np.where(y == 1, share / have, (1 - share) / (1 - have)).astype(np.float32)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column as one array, and where each text begins; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column as one array, and where each list begins; null is empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return np.asarray(column.flatten()), starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam over a list of arrays, changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
