"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightnet.llm.decontaminate import find_contamination
from freightnet.llm.jaccard import one_of_each
from freightnet.llm.mixing import mix_sources
from freightnet.llm.secrets import redact, scan
from freightnet.llm.toxicity import apply_network, fit_network
from freightnet.scale import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that the network finds toxic; the labels table is read for training only. Without both a toxic and
    a clean labelled document there is nothing to tell them by, and all stay."""
    net = fit_network(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if net.constant is not None:
        return docs
    return _columns(apply_network(docs, net).where(F.col("score") < 0.5), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return one_of_each(docs, size=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents with a verbatim match of a benchmark window."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.col("n_hit") == 0)
    return _columns(found, docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; no document goes."""
    return redact(scan(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' own columns, in order."""
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("drop_toxic", drop_toxic),
    ("drop_copies", drop_copies),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("mix", mix),
]

#: Trained weights decide in the first stage: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
