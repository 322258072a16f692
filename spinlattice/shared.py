"""The folder that driver and executors share, and places in an order of cut points."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a folder of our own is used in a single process alone, as in tests: on a cluster it would be another one on
    every machine.
    """
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not path and master != "local" and not master.startswith(("local[", "local*")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or "/tmp/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lost executors cost no recomputation, and several readers share one run."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """What independent steps return, run at the same time: one's small jobs leave cores to the others. All have ended before an error is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [x.result() for x in begun]


def file_system(spark: SparkSession, path: str):
    """The store of ``path`` and the path as the store knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def literal_array(values: list, kind: str) -> Column:
    """One constant array, however long, where a literal for each value would be a tree of them."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


#: So many cuts are written out as a tree of conditions, which Spark compiles; a fold over an array costs microseconds a row.
WRITTEN_OUT = 64


def place(key: Column, cuts: list, kind: str) -> Column:
    """The number of ascending ``cuts`` at or below ``key`` by halving steps, 0 for a null key."""
    if not cuts:
        return F.lit(0)
    if len(cuts) <= WRITTEN_OUT and None not in cuts:

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key < F.lit(cuts[middle]).cast(kind), tree(low, middle)).otherwise(tree(middle + 1, high))

        return F.when(key.isNull(), 0).otherwise(tree(0, len(cuts)))
    at = literal_array(cuts, kind)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    fold = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(at, p + s - 1) <= key), p + s).otherwise(p))
    return F.when(key.isNull(), 0).otherwise(fold)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place ``at`` (0, 1, 2, ...) in the whole order, from sorted ranges in the shared folder; the driver holds
    one number a range."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    table = materialize(dealt, name).withColumn("_part", F.shiftright("_row", 33).cast("int"))
    offsets, before = [], 0
    for r in sorted(table.groupBy("_part").count().collect()):
        offsets.append((r["_part"], before))
        before += r["count"]
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    at = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(F.broadcast(known), "_part").withColumn("at", at).drop("_part", "_row", "_before")
