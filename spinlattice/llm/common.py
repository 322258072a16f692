"""Helpers that the training-data operators share: table reading, shared-folder
tables and Column building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, materialize, new_path, shared_dir  # noqa: F401

#: Words as every contract here splits them: runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Occurrences from which a key is dealt to SALTS tasks.
HOT, SALTS = 10_000, 16


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (a row for each ``key``, which ``n`` of rows have) that leaves no key to one task.

    Keys of HOT rows or more, of which there are at most one in HOT, are dealt by ``spread`` to SALTS tasks each, the others joined as they are; without
    any it is a plain join. ``facts`` are read more than once, so they should be stored. Columns of the two sides must not share names but the key."""
    if facts.where(F.col(n) >= HOT).limit(1).isEmpty():
        return rows.join(facts, key)
    salted = facts.where(F.col(n) >= HOT).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_hot", F.lit(True))
    both = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left")
    hot = both.where("_hot").drop("_salt", "_hot")
    cold = both.where("_hot is null").select(*rows.columns).join(facts.where(F.col(n) < HOT), key)
    return hot.unionByName(cold)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``: a lambda variable is never inlined
    again for every element, a projected column might be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of words of a text (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def range_bounds(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` ascending cut points of ``key``, approximate quantiles over
    all rows; only that column is read. The list is bounded by ``n``."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), 20 * n).alias("b")).first()["b"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list) -> Column:
    """Number of cut points at or below ``key``; nulls go first, to bucket 0."""
    if not bounds:
        return F.lit(0)
    b = F.array(*map(F.lit, bounds))
    # binary search as a fold: log2(n) steps, each halving the step width
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda p, s: F.when((p + s <= len(bounds)) & (F.get(b, p + s - 1) <= key), p + s).otherwise(p),
    )
    return F.when(key.isNull(), F.lit(0)).otherwise(at)
