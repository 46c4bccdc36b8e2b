"""A corpus pipeline: five stages, each a DataFrame of documents made from the one before.

Every stage works on all rows that its predecessor kept. All but the last return the
columns of documents; the last adds how many words the mix takes. Nulls, ties and repeated rows:

toxicity        a null text scores like an empty one; rows that repeat an id are judged each by its own text.
near_copies     rows without doc_id or words stay; of rows that share an id all stay or all go.
repeated_bytes  a null text stays null; a row without doc_id is neither cut nor an earlier place.
benchmark_free  rows without doc_id stay; of rows that share an id all go if one holds an item.
mixing          rows are known by a number of their own; empty texts and nulls have no words to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.decontamination import decontaminate
from cladeframe.llm.mixing import mixed
from cladeframe.llm.set_join import set_join
from cladeframe.llm.suffixes import dedup_bytes
from cladeframe.llm.toxicity import toxicity_threshold, train_toxicity, with_toxicity
from cladeframe.llm.words import free_name
from cladeframe.operators.staging import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; all, if nothing could be learned."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.trained:
        return docs
    score = free_name(docs, "_toxicity")
    scored = with_toxicity(docs, model, score)
    return scored.where(F.col(score) < toxicity_threshold(model, F.col("lang"))).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with alike shingle sets the one with the smallest id."""
    other = free_name(docs, "_other")
    others = set_join(docs).where("not kept").select(F.col("doc_id").alias(other))
    return docs.join(others, F.col("doc_id") == F.col(other), "left_anti")


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that occur earlier.

    A character of which a byte goes, goes whole, so that what is left is text.
    """
    cut = dedup_bytes(docs, whole_characters=True).withColumn(
        "text", F.when(F.col("text").isNotNull(), F.make_valid_utf8(F.col("kept").cast("string")))
    )
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each, repeats counted.

    Rows without a doc_id and rows that share one are documents of their own.
    """
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_bytes", repeated_bytes),
    ("benchmark_free", benchmark_free),
    ("mixing", mixing),
]

# Learned models and sketches have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
