"""A training corpus from `documents`, stage by stage.

Each stage reads what its predecessor kept, works on all of it, and returns the columns of documents
(doc_id, text, lang, source, n_chars); the last one adds what it decided. Between stages the rows are
written as Parquet to the folder of spark.checkpoint.dir, so a lost executor costs no earlier stage.

Nulls, empty texts and repeated rows: documents without a letter, and those whose n-grams no learned
language explains, are rejected by the first stage, null and empty texts with them; a null lang becomes
the identified one; rows that repeat a text are copies; the later stages decide row by row, whatever the
doc_id, so rows with a null or shared one stay or go on their own (only the draw of the last stage, a hash
of doc_id, is one for all rows that share it); other columns are left out at the start; very long texts are
read whole by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from weirgate.llm.common import cut, shared_checkpoints, small_side, with_rows

#: Candidates for near copies differ in so many bits of a fingerprint over words at most.
NEAR_BITS = 6
#: Share of a text's n-grams that its language must explain; of held-out documents the least is 0.42, of unlearned languages the most 0.14.
EVIDENCE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the labelled ones identify, with it where lang is null; the rest is rejected."""
    docs = docs.select(*COLUMNS)
    told = language_id.classify(docs, language_id.learn(docs)).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("evidence") >= EVIDENCE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content, that with the smallest doc_id."""
    return exact_dedup.survivors(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles 0.8 similar or more), that with the smallest doc_id."""
    docs = with_rows(docs.select(*COLUMNS))
    copies = cut(simhash.near_copies(docs, shingle=5, similarity=0.8, radius=NEAR_BITS).where("row <> near_id").select("row"))
    return docs.join(small_side(copies, copies.count()), "row", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with few edits."""
    docs = with_rows(docs.select(*COLUMNS))
    by_row = docs.select(F.col("row").alias("doc_id"), "text")
    leaks = cut(decontaminate.decontaminate(by_row, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("row")).distinct())
    return docs.join(small_side(leaks, leaks.count()), "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled mixture, with each document's topic, tokens and probability."""
    docs = with_rows(docs.select(*COLUMNS))
    mixed = mixing.mix(docs, carry=("row",)).where("kept").select("row", "topic", "n_tokens", "probability")
    return docs.join(mixed, "row").drop("row")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: SimHash components, edit-distance search and raking are not SQL: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written and read again."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
