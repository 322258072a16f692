"""Stored tables and the streams that fill them: what a change writes, repeated batches, late rows."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from spinlattice.operators import maintenance
from spinlattice.queries.files import store
from spinlattice.sources.pages import SortedPages
from spinlattice.sources.tables import Conflict, KeyedTable, State
from spinlattice.streaming import jobs


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i if i >= 5 else None, f"v{i}") for i in range(1000)]
    return KeyedTable.create(spark.createDataFrame(rows, "k long, v string"), str(tmp_path / "t"), "k", rows_per_file=100)


def test_a_change_writes_only_what_it_meets(spark, table):
    before = table.state()
    assert len(before.files) >= 8 and sum(f[2] for f in before.files) == 1000 and before.files[0][1] is None
    some = spark.createDataFrame([(500, "new"), (501, "new"), (501, "old")], "k long, v string")
    maintenance.upsert(table, some, ["k"], "v")
    after = table.state()
    old, new = {f[0] for f in before.files}, {f[0] for f in after.files}
    assert 1 <= len(old - new) <= 2 and len(old & new) == len(before.files) - len(old - new)
    want = {(i if i >= 5 else None, f"v{i}") for i in range(1000)} - {(500, "v500"), (501, "v501")} | {(500, "new"), (501, "old")}
    assert set(rows_of(table.read())) == want and set(rows_of(table.read(0))) != want


def test_keys_beyond_all_ranges_and_null_keys(spark, table):
    maintenance.upsert(table, spark.createDataFrame([(-7, "low"), (10**12, "high")], "k long, v string"), ["k"], "v")
    got = rows_of(table.read())
    assert (-7, "low") in got and (10**12, "high") in got and len(got) == 1002
    lows = [f[1] for f in table.state().files]
    assert lows[1:] == sorted(lows[1:])
    jobs.append_rows(spark.createDataFrame([(None, "more")], "k long, v string"), table, "j", 0)
    assert table.read().where("k is null").count() == 6 and table.state().files[0][1] is None


def test_deletes_read_before_they_write(spark, table):
    table.change(spark.range(300, 400).select(F.col("id").alias("k")), lambda rows: rows.where("k is null or k not between 300 and 399"), inserts=False)
    names = [f[0] for f in table.state().files]
    table.change(spark.range(310, 390).select(F.col("id").alias("k")), lambda rows: rows.where("k < 0"), inserts=False)  # gone already
    assert [f[0] for f in table.state().files] == names and table.read().count() == 900


def test_everything_deleted_and_filled_again(spark, table):
    table.change(table.read().select("k"), lambda rows: rows.where("false"), inserts=False)
    assert table.read().count() == 0 and table.state().files == []
    maintenance.upsert(table, spark.createDataFrame([(3, "x")], "k long, v string"), ["k"], "v")
    assert rows_of(table.read()) == [(3, "x")]


def test_a_batch_counts_once(spark, table):
    rows = spark.createDataFrame([(5, "again"), (2000, "again")], "k long, v string")
    for batch, want in ((0, 1002), (0, 1002), (1, 1004), (0, 1004), (1, 1004)):
        jobs.append_rows(rows, table, "job", batch)
        assert table.read().count() == want
    jobs.append_rows(rows, table, "another", 0)
    assert table.read().count() == 1006
    jobs.append_rows(rows.limit(0), table, "job", 2)  # nothing to add, but seen
    assert table.state().applied == {"job": 2, "another": 0}


def test_two_writers(spark, table):
    now = table.state()

    def late(rows):
        jobs.append_rows(spark.createDataFrame([(7, "first")], "k long, v string"), table, "quick", 0)
        return rows.where("false")

    with pytest.raises(Conflict):
        table.change(spark.createDataFrame([(7,)], "k long"), late)
    assert table.read().count() == 1001 and table.state().version == now.version + 1
    with pytest.raises(Conflict):
        table._publish(State(0, [], {}, now.schema))


def test_vacuum(spark, table):
    for i in range(3):
        maintenance.upsert(table, spark.createDataFrame([(10, f"n{i}")], "k long, v string"), ["k"], "v")
    want = rows_of(table.read())
    table.vacuum(keep=2)
    assert table.versions() == [2, 3] and rows_of(table.read()) == want and table.read(2).count() == 1000


def test_string_keys(spark, tmp_path):
    names = ["", "a", "B", "é", "漢", "z" * 50, "\U0001f600"] + [f"n{i}" for i in range(50)]
    table = KeyedTable.create(spark.createDataFrame([(n, 0) for n in names], "k string, n int"), str(tmp_path / "s"), "k", rows_per_file=5)
    for n in names + ["new"]:
        maintenance.upsert(table, spark.createDataFrame([(n, 1)], "k string, n int"), ["k"], "n") if n in ("", "é", "new", "漢") else None
    assert rows_of(table.read()) == sorted([(n, int(n in ("", "é", "漢"))) for n in names] + [("new", 1)], key=str)


def results(spark, rows):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    return spark.createDataFrame([(t, k, 120.0, 0.5, at(s)) for t, k, s in rows], "track_id long, key_camelot string, bpm double, confidence double, at timestamp")


def test_result_batches_compose_and_repeat(spark, tmp_path):
    tracks = KeyedTable.create(spark.createDataFrame([(i, None, None, "pending", None) for i in range(4)], "track_id long, key_camelot string, bpm double, status string, analyzed_at timestamp"), str(tmp_path / "t"), "track_id", 2)
    opinions = KeyedTable.create(spark.createDataFrame([(0, "tagcsv", "1A", 99.0, 1.0, None)], "track_id long, source string, key_camelot string, bpm double, confidence double, at timestamp"), str(tmp_path / "o"), "track_id")
    batches = [results(spark, [(0, "8A", 5), (1, "9A", 1)]), results(spark, [(0, "2B", 4), (1, "9B", 2), (7, "3A", 1)]), results(spark, [(2, "4A", 1)])]
    for order in ([0], [0, 1], [1, 2], [0, 1, 2]):  # batches come again
        for n in order:
            jobs.store_results(batches[n], tracks, opinions, "results", n)
    got = {(r["track_id"], r["source"]): r["key_camelot"] for r in opinions.read().collect()}
    assert got == {(0, "tagcsv"): "1A", (0, "engine"): "8A", (1, "engine"): "9B", (2, "engine"): "4A", (7, "engine"): "3A"}
    assert rows_of(tracks.read().select("track_id", "key_camelot", "status")) == [(0, "8A", "analyzed"), (1, "9B", "analyzed"), (2, "4A", "analyzed"), (3, None, "pending")]


def test_discovery_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    catalog = KeyedTable.create(spark.createDataFrame([], "file_path string, filename string, file_size long, status string, modified timestamp"), str(tmp_path / "c"), "file_path")
    scan = lambda: jobs.run(jobs.listing(spark, str(folder), 1), lambda rows, n: jobs.discover(rows, catalog, "scan", n), str(tmp_path / "progress"))
    for i, name in enumerate(["a.mp3", "b.txt", "c.WAV"]):
        (folder / name).write_bytes(b"x" * (i + 1))
    scan()
    first = rows_of(catalog.read().select("filename", "file_size", "status"))
    assert first == [("a.mp3", 1, "pending"), ("c.WAV", 3, "pending")]
    version = catalog.state().version
    scan()
    assert catalog.state().version == version  # nothing new
    (folder / "d.flac").write_bytes(b"1234")
    scan()
    assert rows_of(catalog.read().select("filename", "file_size", "status")) == [*first, ("d.flac", 4, "pending")]


def test_late_and_idle_taps(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    source = str(tmp_path / "in")
    batches = [[(1, 0.0), (1, 1.0), (1, 0.5)], [(1, 400.0), (2, 401.0)], [(1, 2.0), (1, 400.5), (1, 399.0)], [(9, 9000.0)], [(1, 8990.0), (1, 1.5)], [(9, 20000.0)]]
    for rows in batches:
        spark.createDataFrame([(s, at(t)) for s, t in rows], "session_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("session_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    held = KeyedTable.create(spark.createDataFrame([], "session_id long, ts timestamp, bpm long"), str(tmp_path / "o"), "session_id")
    with store(spark, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        jobs.run(jobs.tap_tempo(stream, "60 seconds", 600.0), lambda rows, n: jobs.append_rows(rows, held, "taps", n), str(tmp_path / "p"))
    got = sorted((r["session_id"], (r["ts"] - at(0)).total_seconds(), r["bpm"]) for r in held.read().collect() if r["session_id"] != 9 or r["ts"] < at(10000))
    # 2.0 and 1.5 come over a minute after newer taps and are dropped; 8990 is in time and begins a session anew
    assert got == [(1, 0.0, None), (1, 0.5, 120), (1, 1.0, 120), (1, 399.0, 20), (1, 400.0, 20), (1, 400.5, 20), (1, 8990.0, None), (2, 401.0, None), (9, 9000.0, None)]


@pytest.mark.parametrize(("sort", "descending"), [("bpm", True), ("bpm", False), ("name", True), ("name", False)])
def test_pages_read_only_their_blocks(spark, tmp_path, sort, descending):
    rows = [(i, None if i % 13 == 0 else float(i % 17), None if i % 11 == 0 else f"n{i % 23}", i % 3) for i in range(500)]
    pages = SortedPages.create(spark.createDataFrame(rows, "track_id long, bpm double, name string, kind int"), str(tmp_path / "p"), sort, descending, block_rows=40)
    at = {"bpm": 1, "name": 2}[sort]
    some, none = ([r for r in rows if (r[at] is None) == x] for x in (False, True))
    some.sort(key=lambda r: r[0])
    some.sort(key=lambda r: r[at], reverse=descending)
    whole = some + none if descending else none + some
    for kind in (None, 1):
        want = [r for r in whole if kind is None or r[3] == kind]
        for offset, limit in ((0, 7), (33, 20), (150, 30), (490, 50), (9999, 5)):
            page = pages.page(offset, limit, None if kind is None else F.col("kind") == kind)
            assert [tuple(r) for r in page.rows.collect()] == want[offset : offset + limit] and page.total == len(want)
            assert kind is not None or len(page.blocks) <= 3


def test_a_table_is_made_from_rows_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = KeyedTable.create(spark.range(1000).withColumnRenamed("id", "k").mapInArrow(look, "k long"), str(tmp_path / "o"), "k", files=5)
    assert seen.value == 1000 and made.read().count() == 1000 and made.rows_per_file == 200 and 3 <= len(made.state().files) <= 7


def test_a_change_works_its_rows_out_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    before = table.state()
    keys = spark.range(485, 515).select(F.col("id").alias("k"))
    after = table.change(keys, lambda rows: rows.mapInArrow(look, rows.schema))
    met = [f for f, g in zip(before.files, [*before.files[1:], None], strict=True) if (f[1] is None or f[1] < 515) and (g is None or g[1] > 485)]
    assert seen.value == sum(f[2] for f in met) >= 50  # once, not once more for a sample
    assert len(after.files) == len(before.files) and rows_of(table.read()) == rows_of(table.read(0))


def test_a_file_that_grows_too_large_is_cut(spark, table):
    more = spark.range(1_000_000, 1_000_900).select(F.col("id").alias("k"), F.lit("more").alias("v"))
    before = len(table.state().files)
    jobs.append_rows(more, table, "j", 0)
    files = table.state().files
    assert len(files) >= before + 6 and max(f[2] for f in files) < 400 and table.read().count() == 1900
    assert [f[1] for f in files[1:]] == sorted(f[1] for f in files[1:])


def test_steps_run_together_and_all_end(spark):
    import threading

    from spinlattice.shared import together

    met, ended = threading.Barrier(2, timeout=60), []

    def well():
        met.wait()
        ended.append(spark.range(10).count())
        return ended[0]

    def badly():
        met.wait()
        raise KeyError("x")

    with pytest.raises(KeyError):
        together(spark, badly, well)
    assert ended == [10] and together(spark, lambda: 1, lambda: 2) == [1, 2]


@pytest.mark.parametrize("kind,values", [("bigint", [-5, 0, 3, 3_000_000_000]), ("string", ["a'b", "m", "é"]), ("double", [-0.5, 1.25, 7.0])])
def test_places_by_conditions_are_those_by_the_fold(spark, monkeypatch, kind, values):
    from spinlattice import shared

    keys = spark.createDataFrame([(None,), *((x,) for v in values for x in (v, *((v - 1, v + 1) if kind != "string" else (v + "x", ""))))], f"k {kind}")
    written = keys.select("k", shared.place(F.col("k"), values, kind).alias("at"))
    assert "lambda" not in written._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in written.collect()]
    monkeypatch.setattr(shared, "WRITTEN_OUT", 0)
    assert got == [tuple(r) for r in keys.select("k", shared.place(F.col("k"), values, kind).alias("at")).collect()]
    assert got == [(k, 0 if k is None else sum(v <= k for v in values)) for k, _ in got]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_results_work_the_opinions_out_once(spark, monkeypatch):
    from spinlattice.queries import files, registry

    asked, view = [], registry.view
    monkeypatch.setattr(registry, "view", lambda spark, folder, name: asked.append(name) or view(spark, folder, name))
    files.results_stored(registry.Source(spark, "/root/testdata/sf0.001"))
    assert asked.count("v_opinions") == 1


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for name, put in (("appended", jobs.append_rows), ("merged", jobs.merge_updates)):
        into = KeyedTable.create(spark.createDataFrame([], "k long"), str(tmp_path / name), "k")
        before = seen.value
        put(spark.range(100).withColumnRenamed("id", "k").mapInArrow(look, "k long"), into, "job", 0)
        assert seen.value - before == 100 and into.read().count() == 100
        # a repeated batch changes nothing, but its operators run, as their state must be there for the next one
        put(spark.range(100).withColumnRenamed("id", "k").mapInArrow(look, "k long"), into, "job", 0)
        assert seen.value - before == 200 and into.read().count() == 100


class FakeState:
    def __init__(self, empty):
        self.empty, self.value = empty, empty

    def exists(self):
        return self.value != self.empty

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendValue(self, value):  # noqa: N802
        self.value = [*self.value, value]

    def clear(self):
        self.value = self.empty


class FakeHandle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getListState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, FakeState([]))

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, FakeState(None))

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_a_session_waits_for_one_timer():
    import pandas as pd

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    handle, start = FakeHandle(), 1_700_000_000_000
    taps = jobs.Taps(600.0)
    taps.init(handle)
    batch = lambda seconds: [pd.DataFrame({"ts": pd.to_datetime([start + 1000 * s for s in seconds], unit="ms")})]
    taps.handleInputRows((7,), batch(range(500, 0, -1)), Times(0))
    assert handle.timers == [start + 1000]  # not one a tap
    taps.handleInputRows((7,), batch([900, 0]), Times(0))
    assert handle.timers == [start + 1000, start]  # an earlier tap needs one of its own
    (out,) = taps.handleExpiredTimer((7,), Times(start + 100_000), None)
    assert len(out) == 101 and out["bpm"].tolist()[1:] == [60] * 100 and handle.timers[2:] == [start + 101_000]
    assert list(taps.handleExpiredTimer((7,), Times(start + 100_000), None)) == [] and len(handle.timers) == 3  # one that is left over does nothing
    (out,) = taps.handleExpiredTimer((7,), Times(start + 900_000), None)
    assert len(out) == 401 and handle.timers[3:] == [start + 1_500_001]
    assert list(taps.handleExpiredTimer((7,), Times(start + 1_500_001), None)) == [] and not any(s.exists() for s in handle.states.values())
