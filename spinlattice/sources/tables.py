"""Tables whose states are numbered: a change writes only the files it meets, and a repeated batch changes nothing.

A state is a list of Parquet files with disjoint ranges of one key, kept as one small file of JSON lines in the table's
ledger, beside the last batch that each stream has put in. A change finds the files whose ranges hold its
keys, makes their new rows, writes these to new files and publishes the next state by a rename that fails if the state exists. Until
then readers see the old one, so a task, an executor or the driver may be lost anywhere on the way and the batch be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import discard, file_system, new_path, place

c = F.col


#: A file may grow to so many times the rows that a file is to have before a change cuts it.
MOST_OVER = 1.5


class Conflict(RuntimeError):
    """Another writer has published this state first; nothing of ours is visible."""


@dataclass
class State:
    """``files`` are (path, least key or None, rows) in order of keys; the first file has null keys, if any file has."""

    version: int
    files: list[tuple[str, object, int]]
    applied: dict[str, int]
    schema: StructType


class KeyedTable:
    """A table in the folder ``root``, cut by ranges of ``key`` (whole numbers, strings or doubles) to files of about ``rows_per_file``."""

    def __init__(self, spark: SparkSession, root: str, key: str, rows_per_file: int = 1_000_000):
        self.spark, self.root, self.key, self.rows_per_file = spark, root.rstrip("/"), key, rows_per_file

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, rows_per_file: int = 1_000_000, files: int | None = None) -> KeyedTable:
        """``files``: about so many, instead of ``rows_per_file``. The rows are worked out once; they are counted, sampled and dealt from a copy
        in the shared folder."""
        table = cls(rows.sparkSession, root, key, rows_per_file)
        rows.write.parquet(path := new_path(rows.sparkSession, "rows"))
        held = rows.sparkSession.read.schema(rows.schema).parquet(path)
        n = held.count()
        if files:
            table.rows_per_file = max(1, n // files)
        table._publish(State(0, table._write(held, n, []), {}, rows.schema))
        discard(rows.sparkSession, path)
        return table

    # ledger

    def _entry(self, version: int) -> str:
        return f"{self.root}/ledger/{version:012d}"

    def versions(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.root}/ledger")
        if not fs.exists(at):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(at))
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, version: int | None = None) -> State:
        """The newest state, or an earlier one that ``vacuum`` has kept."""
        version = self.versions()[-1] if version is None else version
        lines = self.spark.read.text(self._entry(version)).collect()  # a line a file
        head, *files = sorted((json.loads(r["value"]) for r in lines), key=lambda x: x["n"])
        return State(version, [(f["path"], f["low"], f["rows"]) for f in files], head["applied"], StructType.fromJson(head["schema"]))

    def _publish(self, state: State) -> None:
        head = {"n": -1, "applied": state.applied, "schema": state.schema.jsonValue()}
        state.files.sort(key=lambda f: (f[1] is not None, f[1] if f[1] is not None else 0))
        lines = [head] + [{"n": i, "path": p, "low": low, "rows": rows} for i, (p, low, rows) in enumerate(state.files)]
        fs, final = file_system(self.spark, self._entry(state.version))
        _, draft = file_system(self.spark, f"{self.root}/ledger/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write("\n".join(map(json.dumps, lines)).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"state {state.version} exists")

    # files

    def _kind(self, schema: StructType) -> str:
        return schema[self.key].dataType.simpleString()

    def _write(self, rows: DataFrame, n: int, cuts: list, met: list[int] | None = None) -> list[tuple[str, object, int]]:
        """New files of ``rows``. No file holds keys from both sides of a cut, so that ranges stay disjoint beside the files that stay. With ``met``
        all rows lie in those cells, none of which needs cutting: each is a task, and no rows are worked out beforehand to sample ranges from."""
        folder, schema = f"{self.root}/data/{uuid.uuid4().hex}", rows.schema
        cell = place(c(self.key), cuts, self._kind(schema)).alias("_cell")
        rows = rows.select("*", cell)
        dealt = rows.repartitionById(len(met), place(c("_cell"), met[1:], "int")) if met else rows.repartitionByRange(max(1, -(-n // self.rows_per_file)), "_cell", self.key)
        dealt.sortWithinPartitions("_cell", self.key).write.partitionBy("_cell").parquet(folder)
        got = self.spark.read.schema(StructType([schema[self.key]])).parquet(folder).select(self.key, c("_metadata.file_path").alias("path"))
        stats = got.groupBy("path").agg(F.min(self.key).alias("low"), F.count("*").alias("rows"), F.count(self.key).alias("keyed")).collect()  # a row a file
        return [(r["path"], r["low"] if r["keyed"] == r["rows"] else None, r["rows"]) for r in stats]

    @staticmethod
    def _cuts(files: list[tuple[str, object, int]]) -> list:
        return [low for _, low, _ in files[1:]]

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version))

    def _rows(self, state: State, files: list | None = None) -> DataFrame:
        paths = [p for p, _, _ in (state.files if files is None else files)]
        return self.spark.read.schema(state.schema).parquet(*paths) if paths else self.spark.createDataFrame([], state.schema)

    def change(self, keys: DataFrame, body: Callable[[DataFrame], DataFrame], inserts: bool = True, job: str | None = None, batch: int = 0) -> State:
        """Publish the state in which ``body`` has replaced the rows that ``keys`` (a column named as the key) can meet.

        ``body`` gets the rows of the files met and must leave rows of other keys as they are. Without
        ``inserts`` it adds no keys, and files whose range holds a key but whose rows do not are not met either. A ``batch`` of
        ``job`` that is not above the last one put in has been seen: nothing happens, so batches must come in order,
        as a stream's do. Nulls are a key like any other, in the first file. Files not met keep their names."""
        now = self.state()
        if job is not None and now.applied.get(job, -1) >= batch:
            return now
        kind = self._kind(now.schema)
        asked = keys.select(c(self.key).cast(kind).alias(self.key)).distinct()
        cell = place(c(self.key), self._cuts(now.files), kind)
        brought = {r["cell"]: r["count"] for r in keys.select(c(self.key).cast(kind).alias(self.key)).groupBy(cell.alias("cell")).count().collect()}  # at most a row a file
        met = set(brought)
        if met and not inserts and now.files:
            own = self._rows(now, [f for i, f in enumerate(now.files) if i in met]).select(c(self.key).alias("_key"), c("_metadata.file_path").alias("path"))
            hit = {r["path"] for r in own.join(asked, c("_key").eqNullSafe(c(self.key)), "left_semi").select("path").distinct().collect()}
            met = {i for i, f in enumerate(now.files) if f[0] in hit}
        applied = now.applied | ({job: batch} if job is not None else {})
        old = [f for i, f in enumerate(now.files) if i in met]
        stay = [f for i, f in enumerate(now.files) if i not in met]
        if not met:
            if applied != now.applied:
                self._publish(State(now.version + 1, now.files, applied, now.schema))
            return self.state()
        rows = body(self._rows(now, old)).select(*now.schema.names)
        # a change may bring as many rows as it has keys; a cell is cut only where that may be too many for a file
        held = max((now.files[i][2] if now.files else 0) + (brought[i] if inserts else 0) for i in met)
        if held <= MOST_OVER * self.rows_per_file:
            made = self._write(rows, held, self._cuts(now.files), sorted(met))
        else:
            made = self._write(rows, sum(f[2] for f in old) + (asked.count() if inserts else 0), self._cuts(now.files))
        self._publish(State(now.version + 1, [*stay, *made], applied, now.schema))
        return self.state()

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the newest ``keep`` states and remove the folders that only those used."""
        versions = self.versions()
        held = {p.rsplit("/data/", 1)[1].split("/")[0] for v in versions[-keep:] for p, _, _ in self.state(v).files}
        fs, data = file_system(self.spark, f"{self.root}/data")
        for v in versions[:-keep]:
            fs.delete(file_system(self.spark, self._entry(v))[1], False)
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if x.getPath().getName() not in held:
                fs.delete(x.getPath(), True)
