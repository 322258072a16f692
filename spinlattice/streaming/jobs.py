"""Structured Streaming jobs around the catalog."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.catalog import update_columns, upsert
from ..shared import discard, new_path, together
from ..sources.files import MEDIA, media_name
from ..sources.tables import KeyedTable

c = F.col


#: Streams of files take so many a batch; a job may be given another number.
MOST_FILES = 1000


def listing(spark: SparkSession, folder: str, per_batch: int = MOST_FILES) -> DataFrame:
    """A stream of the files below a folder: file_path, filename, extension, file_size, modified. Contents are never read."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = stream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return found.select(c("path").alias("file_path"), *media_name(c("path")), c("length").alias("file_size"), c("modificationTime").alias("modified"))


def run(stream: DataFrame, apply: Callable[[DataFrame, int], object], checkpoint: str, mode: str = "append"):
    """A stream to its end, batch by batch. ``apply`` (rows, number of the batch) must make a repeated batch change nothing, as
    :meth:`KeyedTable.change` does under a job's name: the batch that was under way when the driver was lost comes again."""
    started = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def discover(files: DataFrame, catalog: KeyedTable, job: str, batch: int) -> None:
    """A batch of listed files into a catalog keyed by file_path. Media files not yet known are inserted as pending; a known file's size and name
    are brought up to date and the rest of its row stays; all else is no media file and left out."""
    media = files.where(c("extension").isin(*MEDIA)).withColumn("status", F.lit("pending"))
    columns = catalog.state().schema.names
    known = media.select(*(c(x) if x in media.columns else F.lit(None).alias(x) for x in columns), *(["modified"] if "modified" not in columns else []))
    catalog.change(known, lambda rows: upsert(rows, known, ["file_path"], "modified", keep=["status", *(x for x in columns if x not in media.columns)]), job=job, batch=batch)


def apply_results(tracks: DataFrame, opinions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of analysis results (track_id, key_camelot, bpm, confidence, at) into both tables; the newest of a track counts, and a batch
    applied twice gives the same tables."""
    return _analyzed(tracks, results), _opined(opinions, results)


def _last(results: DataFrame) -> DataFrame:
    return results.groupBy("track_id").agg(F.max_by(F.struct(*results.columns), F.struct("at", "key_camelot", "bpm", "confidence")).alias("r")).select("r.*")


def _analyzed(tracks: DataFrame, results: DataFrame) -> DataFrame:
    """Where tracks carry analyzed_at, a result older than that changes nothing."""
    last = _last(results).withColumnRenamed("at", "analyzed_at")
    if "analyzed_at" not in tracks.columns:
        return update_columns(tracks, last, ["key_camelot", "bpm"], True, "analyzed")
    newer = last.join(tracks.select("track_id", c("analyzed_at").alias("_had")), "track_id").where("_had is null or _had <= analyzed_at").drop("_had")
    return update_columns(tracks, newer, ["key_camelot", "bpm", "analyzed_at"], True, "analyzed")


def _opined(opinions: DataFrame, results: DataFrame) -> DataFrame:
    new = _last(results).select("track_id", F.lit("engine").alias("source"), "key_camelot", "bpm", "confidence", "at")
    state = opinions if "at" in opinions.columns else opinions.withColumn("at", F.lit(None).cast("timestamp"))
    return upsert(state, new, ["track_id", "source"], "at", guard=True)


def store_results(results: DataFrame, tracks: KeyedTable, opinions: KeyedTable, job: str, batch: int) -> None:
    """A batch of results into the stored tables, of which only the files with its tracks are written. Either table knows the job's last
    batch, so whichever of the two was lost is made up for when the batch comes again, and the other stays as it is."""
    ids = results.select("track_id")
    together(
        results.sparkSession,
        lambda: opinions.change(ids, lambda rows: _opined(rows, results), job=job, batch=batch),
        lambda: tracks.change(ids, lambda rows: _analyzed(rows, results), inserts=False, job=job, batch=batch),
    )


@contextmanager
def once(rows: DataFrame):
    """A batch's rows from a copy in the shared folder: every action on ``rows`` itself would run the batch's operators and their state again. A
    repeated batch runs them too, so that its state is there for the next one."""
    rows.write.parquet(path := new_path(rows.sparkSession, "batch"))
    try:
        yield rows.sparkSession.read.schema(rows.schema).parquet(path)
    finally:
        discard(rows.sparkSession, path)


def merge_updates(rows: DataFrame, into: KeyedTable, job: str, batch: int) -> None:
    """The output of an aggregation in update mode into a table with a row a key: a batch's row of a key replaces the one before."""
    with once(rows) as new:
        into.change(new, lambda held: upsert(held, new.withColumn("_batch", F.lit(batch)), [into.key], "_batch"), job=job, batch=batch)


def append_rows(rows: DataFrame, into: KeyedTable, job: str, batch: int) -> None:
    """A batch's rows beside those already there, once."""
    with once(rows) as new:
        into.change(new, lambda held: held.unionByName(new.select(*held.columns)), job=job, batch=batch)


def throughput(events: DataFrame, total: int, late: str = "10 minutes") -> DataFrame:
    """Of (ts, track_id, failed): finished a minute, failures, and the minutes that ``total`` take at that rate."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    return w.select(c("window.start").alias("start"), "n", "failed", (F.lit(total) / c("n")).alias("eta_minutes"))


def latest(events: DataFrame) -> DataFrame:
    """The newest row of each track, for update mode; of rows of one time that with the greatest other values."""
    rest = F.struct("ts", *[x for x in events.columns if x not in ("track_id", "ts")])
    return events.groupBy("track_id").agg(F.max(rest).alias("r")).select("track_id", "r.*")


def tap_tempo(taps: DataFrame, late: str = "1 minute", idle_s: float = 600.0) -> DataFrame:
    """Of (session_id, ts): tempo after each tap from the last four taps, 20 to 300, rounded; null after a session's first.

    Taps wait as state until the watermark, ``late`` behind the newest tap, has passed them, and come out in order of time, so the rows do not depend on
    how taps are dealt to batches. Taps that come later than that are dropped. After ``idle_s`` without a tap a
    session begins anew and its state goes, so what is held does not grow with the number of sessions ever seen. Needs the RocksDB
    state store and append mode; taps behind the last watermark come out when later ones move it."""
    return (
        taps.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late).groupBy("session_id")
        .transformWithStateInPandas(Taps(idle_s), "session_id long, ts timestamp, bpm long", "append", "EventTime")
    )


def tempo_of(held: list[int]) -> int | None:
    """Of up to four tap times in microseconds."""
    gap = (held[-1] - held[0]) / 1e6 / (len(held) - 1) if len(held) > 1 else 0
    return int(min(300.0, max(20.0, 60.0 / gap)) + 0.5) if gap > 0 else None


class Taps(StatefulProcessor):
    """A session's last four taps, and those that the watermark has not passed. A session has a timer for the first of these, and none for the others:
    when it expires all that the watermark has passed come out."""

    def __init__(self, idle_s: float):
        self.idle_us = int(idle_s * 1e6)

    def init(self, handle) -> None:
        # a list of times is one value of bytes: a call and its packing cost more than what they carry
        self.handle, self.waiting, self.known = handle, handle.getListState("waiting", "us binary"), handle.getValueState("known", "held binary, due long")

    def _known(self) -> tuple[list[int], int | None]:
        held, due = self.known.get() or (b"", None)
        return np.frombuffer(held, np.int64).tolist(), due

    def _know(self, held: list[int], due: int | None) -> None:
        if held or due is not None:
            self.known.update((np.array(held, np.int64).tobytes(), due))
        else:
            self.known.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = np.concatenate([pdf["ts"].to_numpy("datetime64[us]").astype(np.int64) for pdf in rows])
        new = new[new > passed]
        if len(new):
            self.waiting.appendValue((new.tobytes(),))
            held, due = self._known()
            if due is None or new.min() < due:
                self._know(held, self._wake(int(new.min())))
        return iter(())

    def _wake(self, first: int) -> int:
        self.handle.registerTimer(-(-first // 1000))
        return first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held, due = self._known()
        if due is not None and due > passed:
            return  # taps have come since, and a timer for them
        waiting = np.sort(np.frombuffer(b"".join(x for (x,) in self.waiting.get()), np.int64))
        n = int(np.searchsorted(waiting, passed, "right"))
        out, rest, bpm = waiting[:n], waiting[n:], []
        for t in out.tolist():
            held = [*held[-3:], t] if held and t - held[-1] <= self.idle_us else [t]
            bpm.append(tempo_of(held))
        if n:
            self.waiting.clear()
            if len(rest):
                self.waiting.appendValue((rest.tobytes(),))
        if not len(rest) and held:
            if passed - held[-1] > self.idle_us:
                held = []
            else:
                self.handle.registerTimer((held[-1] + self.idle_us) // 1000 + 1)
        self._know(held, self._wake(int(rest[0])) if len(rest) else None)
        if n:
            yield pd.DataFrame({"session_id": key[0], "ts": out.view("datetime64[us]"), "bpm": pd.array(bpm, "Int64")})

    def close(self) -> None:
        pass
