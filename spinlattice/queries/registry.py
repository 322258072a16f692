"""Queries by operator number, each with the SQL that a second engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import tasks, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Source:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def tasks(self, table: str) -> int:
        return tasks(self.spark, self.sf_dir, table)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6)


def p6(x: Column) -> Column:
    """:func:`r6` for values of pairs: halves away from zero by arithmetic, as the second engine rounds, where ``round`` makes a decimal of every value."""
    up = F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
    return F.when(x < 0, -up).otherwise(up)
