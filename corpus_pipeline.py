"""A corpus pipeline of five stages; each works on all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet in the shared folder
and reads it again, so a lost executor costs at most the stage at work. Tables may be empty, and documents may have NULLs,
repeated rows or further columns; the operators' modules define what happens to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, mixing, nearcopies, oracles, quality, substrings
from linkloom.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model or the base rules reject go."""
    return quality.good_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return nearcopies.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier in the corpus are cut out."""
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights, with its weights and probabilities (to nine digits)."""
    sampled = mixing.sample(mixing.measure(docs)).filter("sampled").drop("sampled")
    return sampled.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_targets),
]

ORACLE_SQL = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
