"""The corpus pipeline: five stages from documents to token ids, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpometer.llm import decontaminate, pieces, quality, simhash, toxicity
from corpometer.llm.catalog import PIECE_MODEL
from corpometer.llm.common import read_table
from corpometer.session import cleared, delete_paths, fresh_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, learnt from the labelled ones among them, finds good."""
    return quality.without_low_quality(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage search, learnt from the labelled ones among them, finds clean."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles at three bits or fewer join."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in place of its text."""
    return pieces.encoded(docs, pieces.load_model(PIECE_MODEL)).drop("text")


STAGES = [
    ("line quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: Models and fingerprints have no form in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows go to the shared folder and are read back.

    What a stage stores on its way is deleted when its rows are written, and these when the next stage's are.
    """
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete_paths(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
