"""Corpus pipeline: documents to sampled token ids, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitloom.llm import toxicity
from orbitloom.llm.decontaminate import drop_contaminated
from orbitloom.llm.line_windows import dedup_lines
from orbitloom.llm.segment_sampling import sample_segmentations
from orbitloom.llm.setsketch import keep_one
from orbitloom.session import bound_batches, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated three-line passages; n_chars is that of the remaining text.  A document all of
    whose lines are repeated goes; one that had no text before stays."""
    kept = dedup_lines(docs.select(*COLUMNS))
    left = kept.where("n_removed = 0 OR text <> ''")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    bound_batches(spark)
    return keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled segmentations of every remaining document."""
    bound_batches(spark)
    return sample_segmentations(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("sentencepiece", segmented),
]

ORACLE_SQL = None  # the model, the embedding and the sampling are beyond SQL: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
