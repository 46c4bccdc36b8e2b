"""One query per operator over the test tables, with the operators' own defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import fresh_path
from . import language, quality, toxicity
from .collocations import collocations
from .conversations import damaged, repair_report
from .decontamination import contaminated
from .mixing import mix
from .near_vectors import near_vectors
from .set_join import set_join
from .substrings import dedup_substrings
from .suffixes import dedup_bytes
from .token_counts import TokenRollup, inserted, with_bpe_count, with_word_count
from .wrappers import extract
from .words import GAP, crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(module) -> Column:
    """Is the document in the fold that is not learned from? One without doc_id never is learned from."""
    return F.coalesce(crc_fold(F.col("doc_id"), module.FOLDS) == module.HELD_OUT, F.lit(True)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the bar is 0.3."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.with_quality(docs.select("doc_id", "text"), quality.train_quality(docs, labels))
    return scored.select(
        "doc_id",
        _held_out(quality),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles are alike."""
    return set_join(_table(spark, sf_dir, "documents"))


def _token_totals(spark: SparkSession, sf_dir: str, count, tokenizer: str) -> DataFrame:
    """Totals after three batches, the last of them sent twice.

    All documents come in; then those with runs of white space are counted again with each
    run taken as one space; then those labelled toxic go.
    """
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, fresh_path(spark))
    rollup.commit(0, inserted(count(docs), tokenizer))
    tidy = docs.where(F.col("text").rlike(GAP.replace("+", "{2,}"))).withColumn("text", F.regexp_replace("text", GAP, " "))
    rollup.commit(1, inserted(count(tidy), tokenizer, "revise"))
    bad = labels.where("toxic = 1").select("doc_id").distinct()
    gone = docs.join(bad, "doc_id").withColumn("tokens", F.lit(0))
    for _ in range(2):
        rollup.commit(2, inserted(gone, tokenizer, "delete"))
    return rollup.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a public byte-level BPE by source and language, kept by deltas."""
    return _token_totals(spark, sf_dir, with_bpe_count, "byte_bpe_50k@1")


def word_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words for tokens, which SQL can count."""
    return _token_totals(spark, sf_dir, with_word_count, "words@1")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.train_language(docs))
    return found.select(
        "doc_id",
        _held_out(language),
        "lang_pred",
        "score",
        "ambiguous",
    )


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document when repeated 100-byte strings are removed."""
    cut = dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the bar is 0.5, and the calibrated one of its language."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels)
    scored = toxicity.with_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select(
        "doc_id",
        _held_out(toxicity),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.toxicity_threshold(model, F.col("lang")).alias("threshold"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when repeated windows of 50 words are removed."""
    cut = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(_table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words keep together."""
    return collocations(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    return repair_report(damaged(_table(spark, sf_dir, "conversations")), F.col("gone"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_set_join": op3_set_join,
    "op4_token_counts": op4_token_counts,
    "word_token_counts": word_token_counts,
    "op5_language_id": op5_language_id,
    "op6_near_vectors": op6_near_vectors,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_substrings": op10_substrings,
    "op11_html_extraction": op11_html_extraction,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
