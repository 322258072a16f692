"""Deep pages of a sorted table by an index of counts: an offset is found in the counts, and only the blocks it falls in are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..shared import numbered

c = F.col


@dataclass
class Page:
    """A page's rows in order, the number of all rows under its filter, and the blocks that were read for it."""

    rows: DataFrame
    total: int
    blocks: list[int]


class SortedPages:
    """A table in one order, in blocks of ``block_rows`` rows, each a folder that filters on ``_block`` prune."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, order: list[Column]):
        self.spark, self.root, self.schema, self.order = spark, root, schema, order

    @classmethod
    def create(cls, rows: DataFrame, root: str, sort: str, descending: bool = False, key: str = "track_id", block_rows: int = 100_000) -> SortedPages:
        """``rows`` by ``sort``, nulls first or, descending, last; ties by ``key``. Built by sorted ranges: no task holds more than one."""
        # the layout ascends: numbers are turned round for a descending order, texts are numbered from the end
        order = [c(sort).desc_nulls_last() if descending else c(sort).asc_nulls_first(), c(key).asc()]
        kind = rows.schema[sort].dataType.simpleString()
        if descending and kind in ("string", "boolean", "date", "timestamp"):
            ranks = numbered(rows.select(c(sort).alias("_v")).where("_v is not null").distinct(), ["_v"], "pages-ranks").select("_v", (-c("at")).alias("_o"))
            laid = rows.join(ranks, rows[sort] == c("_v"), "left").drop("_v")
        else:
            laid = rows.withColumn("_o", -c(sort) if descending else c(sort))
        laid = laid.withColumn("_n", c("_o").isNull() if descending else c("_o").isNotNull())
        placed = numbered(laid, ["_n", "_o", key], "pages").withColumn("_block", F.floor(c("at") / F.lit(block_rows)).cast("int"))
        placed.drop("_n", "_o", "at").write.partitionBy("_block").parquet(root)
        return cls(rows.sparkSession, root, rows.schema, order)

    def page(self, offset: int, limit: int, where: Column | None = None) -> Page:
        """Rows ``offset`` to ``offset + limit`` of those under ``where``. The counts read only the filter's columns; the driver
        gets a number a block, and rows come from the blocks that the page overlaps."""
        table = self.spark.read.schema(StructType.fromJson(self.schema.jsonValue()).add("_block", IntegerType())).parquet(self.root)
        kept = table if where is None else table.where(where)
        at, total, blocks, skip = 0, 0, [], 0
        for r in sorted(kept.groupBy("_block").count().collect()):
            if at < offset + limit and at + r["count"] > offset:
                skip = skip if blocks else offset - at
                blocks.append(r["_block"])
            at += r["count"]
        total = at
        rows = kept.where(c("_block").isin(blocks)).orderBy(*self.order).offset(skip).limit(limit).drop("_block")
        return Page(rows, total, blocks)
