"""From raw documents to a training mix, a stage at a time.

Each stage gets what the one before it kept, applies one operator, and returns the rows that
stay with the columns of documents; the last returns the mix, a row for each document left.
Stages meet as Parquet in the shared checkpoint folder, so no stage's plan grows with the
number of stages, and a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quernlex.llm.exact import kept_documents
from quernlex.llm.minhash import one_of_each
from quernlex.llm.mixing import mix
from quernlex.llm.toxicity import without_toxic
from quernlex.llm.wumanber import without_contaminated
from quernlex.session import removed, shared_folder, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the threshold go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash_near_dedup", near), ("decontamination", benchmark), ("mixing", mixture)]

#: Trees, components and shares by seeded hashes are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Empty tables and null, empty or repeated rows pass through each stage as its operator says; a row without a label or a language is like any other."""
    docs, done = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:  # what a stage read isn't needed once its own rows are written
            removed(spark, done)
        done = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
