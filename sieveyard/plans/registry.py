"""All queries of the library proper, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveyard.plans import corpus_queries, row_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus_queries.QUERIES | row_queries.QUERIES


def oracles() -> dict[str, str]:
    return corpus_queries.ORACLES | row_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus funnel: each document with the first stage that drops it."""
    return corpus_queries.corpus_funnel(spark, sf_dir)
