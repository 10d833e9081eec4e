"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages work on every row they get; a stage's model and
counts come from its own input. Cases (nulls, empty and long texts, ties, repeated rows, empty tables, extra columns)
are those of the operators.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, flat, language, mixing, neardup, suffixes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, or no letter); the others keep all columns. The model learns from
    the labelled documents it gets, all of them being admitted to its bounded sample; where none has a label, every
    document with a letter stays."""
    columns = docs.columns
    model = language.fit(docs, F.lit(True))
    found = language.identify(docs, model)
    stays = F.col("lang_pred") != "und"
    if not model[1]:
        stays |= F.coalesce(F.col(found.columns[columns.index("text")]).rlike(r"\p{L}"), F.lit(False))
    return found.filter(stays).select(*[f"`{c}`" for c in found.columns[: len(columns)]]).toDF(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that of the least doc_id."""
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated string of 200 bytes out of the texts; n_chars follows the text."""
    columns = docs.columns
    out = suffixes.dedup_spans(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with its ``copy`` number."""
    return mixing.mix(docs)


def _alone(stage):
    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        with flat.stage(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _alone(language_id)),
    ("near_duplicates", _alone(near_duplicates)),
    ("repeated_passages", _alone(repeated_passages)),
    ("benchmark_passages", _alone(benchmark_passages)),
    ("source_mix", _alone(source_mix)),
]

#: The first stage's model and the banded search are not SQL; tests hold run() against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{flat.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
