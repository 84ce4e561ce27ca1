"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the docs of
the next one. All stages but the last return the columns of documents; the last returns the token files' index.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, mixing, near_dup, token_files, toxicity
from brindle.llm.common import stored

#: No stage but mixing can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents outside the held-out fold, then drops what it rejects."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of the least id stays."""
    return near_dup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; the result is what their documents decode to."""
    # workers hold the tables of the stages before too, so this one keeps fewer pieces
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces=1 << 17)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
