"""Token counts kept up to date by deltas.

A batch of changes (insert, revise, delete of one document's count under one tokenizer
version) is turned into signed amounts against the state before it: minus what a document
counted, plus what it counts now. Amounts add up, so totals by source, language and
tokenizer version are sums over batches and no document is counted again.

A batch is one written table holding its amounts and the new state of its documents, each
in a folder of its own, so that totals never read documents. The writer's success marker
commits both at once: a batch that is already committed is left alone when it is sent
again, and one whose job died is written anew. Every `every` batches their sum is written
as a snapshot, by the same rule; what is read is the last snapshot and the batches after
it, so neither a commit nor a total reads all history. A snapshot holds what the batches
up to it hold and changes no result, whether it is there or not.

Defined results: a null text counts 0 tokens; null sources and languages are values of
their own; inserting what is there revises it, revising what is not there inserts it, and
deleting that does nothing; of several changes to one document in a batch the one with the
largest `seq` holds (ties: the largest op, source, lang, tokens); changes without doc_id or
tokenizer are ignored. A total whose documents are all gone stays, with zeros. An empty
batch commits and changes nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import word_count

# Fixed value: how this vocabulary's tokenizer splits text before merging bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

STATE = "kind string, doc_id bigint, tokenizer string, source string, lang string, tokens bigint, docs bigint"
BATCH, SNAPSHOT = "batch-", "snapshot-"
# Batches after which a snapshot is written.
EVERY = 16
CHANGES = ("seq", "op", "doc_id", "source", "lang", "tokenizer", "tokens")


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_bpe_count(docs: DataFrame, column: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the number of byte-level BPE tokens of every whole `text`.

    The vocabulary file, a few hundred kB, is read once here and travels with the job.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(shared.value)
        for text in texts:
            sizes = np.zeros(len(text), np.int64)
            for i, value in enumerate(text):
                if value.is_valid:
                    sizes[i] = len(encoding.encode_ordinary(value.as_py()))
            yield pa.array(sizes)

    return docs.withColumn(column, count("text"))


def with_word_count(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """Add the number of words of every whole `text`."""
    return docs.withColumn(column, word_count(F.col("text")))


class TokenRollup:
    """Totals by source, language and tokenizer version under one folder.

    `path` must be a folder that all executors share. After `every` batches without a
    snapshot a commit writes one.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        if every < 1:
            raise ValueError("every must be at least 1")
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _committed(self, kind: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        whole = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(n for n in names if n.startswith(kind) and files.exists(whole(f"{self.path}/{n}/_SUCCESS")))

    def batches(self) -> list[str]:
        """Names of the committed batches, in the order they were committed in."""
        return self._committed(BATCH)

    def _sources(self) -> list[str]:
        """Folders that hold all history between them: the last snapshot and the batches after it."""
        snapshots = self._committed(SNAPSHOT)[-1:]
        covered = snapshots[0].removeprefix(SNAPSHOT) if snapshots else ""
        return snapshots + [n for n in self.batches() if n.removeprefix(BATCH) > covered]

    def _rows(self, kind: str) -> DataFrame:
        """Rows of one kind, with the number of the batch or snapshot they are in."""
        parts = [
            self.spark.read.schema(STATE)
            .parquet(f"{self.path}/{name}")
            .where(F.col("kind") == kind)
            .withColumn("batch", F.lit(name.split("-")[1]))
            for name in self._sources()
        ]
        if not parts:
            return self.spark.createDataFrame([], STATE).withColumn("batch", F.lit(""))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def state(self) -> DataFrame:
        """Every document's last count: doc_id, tokenizer, source, lang, tokens, docs (0 if deleted)."""
        last = F.max_by(F.struct("source", "lang", "tokens", "docs"), "batch").alias("_last")
        return self._rows("document").groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "_last.*")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, tokens and docs."""
        sums = [F.sum(c).alias(c) for c in ("tokens", "docs")]
        return self._rows("amount").groupBy("source", "lang", "tokenizer").agg(*sums)

    def _write(self, rows: DataFrame, name: str) -> None:
        (
            rows.select(*[field.split()[0] for field in STATE.split(", ")])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("kind")
            .parquet(f"{self.path}/{name}")
        )

    def compact(self) -> bool:
        """Write the state and the totals as they are now as a snapshot; False if the last batch has one."""
        done = self.batches()
        if not done or f"{SNAPSHOT}{done[-1].removeprefix(BATCH)}" in self._committed(SNAPSHOT):
            return False
        none = F.lit(None).cast("bigint").alias("doc_id")
        documents = self.state().withColumn("kind", F.lit("document"))
        amounts = self.totals().select("*", none, F.lit("amount").alias("kind"))
        self._write(documents.unionByName(amounts), f"{SNAPSHOT}{done[-1].removeprefix(BATCH)}")
        return True

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply `changes` (CHANGES) as number `batch`; False if that number was committed before.

        Numbers are not negative, and a new one is larger than those before it.
        """
        name = f"{BATCH}{batch:012d}"
        done = self.batches()
        if name in done:
            return False
        if done and name < done[-1]:
            raise ValueError("a batch can only follow those that are committed")
        order = F.struct("seq", "op", "source", "lang", "tokens")
        new = (
            changes.select(*CHANGES)
            .where("doc_id is not null and tokenizer is not null")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer")
            .agg(F.max_by(F.struct("op", "source", "lang", "tokens"), order).alias("_new"))
        )
        old = self.state().select(
            "doc_id",
            "tokenizer",
            F.struct("source", "lang", "tokens", "docs").alias("_old"),
        )
        gone = F.col("_new.op") == "delete"
        both = new.join(old, ["doc_id", "tokenizer"], "left").select(
            "doc_id",
            "tokenizer",
            F.struct(
                F.when(gone, F.col("_old.source")).otherwise(F.col("_new.source")).alias("source"),
                F.when(gone, F.col("_old.lang")).otherwise(F.col("_new.lang")).alias("lang"),
                F.when(gone, 0).otherwise(F.coalesce("_new.tokens", F.lit(0))).cast("long").alias("tokens"),
                F.when(gone, 0).otherwise(1).cast("long").alias("docs"),
            ).alias("_now"),
            F.struct(
                F.col("_old.source").alias("source"),
                F.col("_old.lang").alias("lang"),
                (-F.coalesce("_old.tokens", F.lit(0))).cast("long").alias("tokens"),
                (-F.coalesce("_old.docs", F.lit(0))).cast("long").alias("docs"),
            ).alias("_back"),
            (F.col("_old").isNotNull() | ~gone).alias("_known"),
        ).where("_known")
        moved = both.select(
            "doc_id",
            "tokenizer",
            F.explode(
                F.array(
                    F.struct(F.lit("document").alias("kind"), "_now.*"),
                    F.struct(F.lit("amount").alias("kind"), "_now.*"),
                    F.struct(F.lit("amount").alias("kind"), "_back.*"),
                )
            ).alias("_row"),
        ).select("doc_id", "tokenizer", "_row.*")
        amount = F.col("kind") == "amount"
        # Amounts are summed up before they are shuffled; documents have groups of their own.
        rows = (
            moved.where("kind = 'document' or docs <> 0 or tokens <> 0")
            .groupBy(F.when(~amount, F.col("doc_id")).alias("doc_id"), "kind", "tokenizer", "source", "lang")
            .agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        )
        self._write(rows, name)
        if sum(n.startswith(BATCH) for n in self._sources()) >= self.every:
            self.compact()
        return True


def inserted(docs: DataFrame, tokenizer: str, op: str = "insert", seq: int = 0) -> DataFrame:
    """Changes from counted documents (doc_id, source, lang, tokens)."""
    return docs.select(
        F.lit(seq).alias("seq"),
        F.lit(op).alias("op"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.col("tokens").cast("long").alias("tokens"),
    )
