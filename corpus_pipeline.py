"""A training corpus in five stages, each an operator of ``millrace.llm``.

``STAGES`` lists them in order.  Each takes (spark, docs, sf_dir) and returns a
DataFrame; it is written as Parquet and read again as the documents of the next
stage.  All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, langid, mixing, secrets, simhash
from millrace.llm.shared import drop_path, fresh_path, scratch, table, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, those unlike every language, and those in another language than ``lang`` says go."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, the document with the least doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources and shuffled."""
    return mixing.replicate(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("source_mixing", mix),
]

#: SQL can't express the hyperdimensional profiles of the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage made on the way, and the table before it, are removed when it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
