"""A corpus pipeline: five operators of ``vantagrain.llm`` in a row.

Every stage works on all rows the stage before kept and returns the columns of
``documents``; the last returns the tokens.  ``run`` writes each stage's result
to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vantagrain.llm import bpe, decontam, quality_rules, simhash, substring
from vantagrain.llm.queries import table, tokenizer_path
from vantagrain.llm.runtime import delete, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: links are op2's four bits
    of a fingerprint and, beside them, Jaccard 0.8 of five-word shingles, verified."""
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that also start earlier go; ``n_chars`` follows the text."""
    cut = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontam.drop_copies(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, and their digests."""
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"), "input_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("substring", repeated_passages),
    ("decontamination", decontamination),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's intermediate tables go once its result is written,
    and its result once the next stage's is.  What the last stage reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete(spark, before)
        before = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # fingerprints, alignments and merges are beyond SQL; tests/llm has brute force
