"""A training corpus from raw documents: toxic documents, near copies and benchmark leaks go, secrets are masked, sources are mixed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from firmlens.llm.decontaminate import without_benchmark
from firmlens.llm.jaccard import one_per_group
from firmlens.llm.mixing import mix_sources
from firmlens.llm.secret_scan import redact
from firmlens.llm.toxicity import without_toxic
from firmlens.session import remove, scratch, shared_root, ship_package

#: The learned first stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trusted with ``labels`` rejects go."""
    ship_package(spark)
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship_package(spark)
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return without_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    ship_package(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same expected share; rows come in a global random order."""
    ship_package(spark)
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage.

    Side tables of a stage go once its result is written, and so do the documents it read. The last stage is returned unwritten.
    """
    docs = _table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/firmlens/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            remove(spark, f"{root}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
