"""Queries by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import answers, index, runs, text, values, vectors, web

_ALL = vectors.QUERIES | text.QUERIES | web.QUERIES | index.QUERIES | answers.QUERIES | values.QUERIES | runs.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
