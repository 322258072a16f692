"""Connected components by alternating star contraction, all in shuffles of edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, new_path


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours. A component's root ends with all its nodes as
    neighbours, so hubs are joined in parts."""
    both = _both(edges)
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree")), "u long, m long, degree long")
    return join_hot(both.where("v > u"), least, "u", "degree", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them; u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): node, component (least node reachable), for nodes with an edge.

    Rounds grow with the logarithm of a component's diameter. Each round's tables are
    written to the shared folder, each by a small plan of its own that several readers share, those of the round before removed; only the edges' number and a
    checksum come to the driver. Loops and repeated edges change nothing, no edges give no rows.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def written(df: DataFrame, schema: str = "u long, v long") -> DataFrame:
        df.write.parquet(path := new_path(spark, "cc"))
        paths.append(path)
        return spark.read.schema(schema).parquet(path)

    start = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct()
    now, seen = written(start), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = written(_small_star(written(_large_star(now, written))))
        while len(paths) > 1:  # the new table is whole, so nothing reads the others again
            discard(spark, paths.pop(0))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
