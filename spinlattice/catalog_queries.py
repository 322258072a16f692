"""All registered queries of the catalog, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import catalog, files, maintenance, scalars, signals  # noqa: F401
from .queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top harmonic neighbours of every track in each relation."""
    return QUERIES["f05_top_per_relation"](spark, sf_dir)
