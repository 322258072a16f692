"""Files that the source queries write for the library to read."""

import os

import pytest
from pyspark.sql import functions as F

from spinlattice.queries import files as q
from spinlattice.queries.registry import Source
from spinlattice.sources import files


def test_a_file_each_is_many_tasks_and_holds_the_whole_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q, "FILES_A_TASK", 50)
    values = {f"s{i}": ["", None, " è 'x', \"y\"\\ ", "two\nlines"][i % 4] for i in range(400)}
    rows = spark.createDataFrame(list(values.items()), "stem string, value string")
    path = q.one_file_each(Source(spark, ""), rows, str(tmp_path / "each"), "wav")
    found = {name: os.path.join(at, name) for at, _, names in os.walk(path) for name in names}
    assert set(found) == {f"{stem}.wav" for stem in values}
    for stem, value in values.items():
        with open(found[f"{stem}.wav"], encoding="utf-8") as f:
            assert f.read() == (value or "") + "\n"
    assert len({os.path.dirname(x) for x in found.values()}) == 8  # one folder a task, however few bytes the rows have


def test_files_written_again_are_replaced(spark, tmp_path):
    v, path = Source(spark, ""), str(tmp_path / "again")
    for value in ("first", "second"):
        q.one_file_each(v, spark.createDataFrame([("s1", value), ("s2", value)], "stem string, value string"), path, "wav")
    q.one_file_each(v, spark.createDataFrame([("s1", "d41d8cd98f00b204e9800998ecf8427e")], "stem string, value string"), str(tmp_path / "sums"), "md5")
    got = files.integrity(spark, path, str(tmp_path / "sums"), ".wav")
    assert {(r["stem"], r["status"]) for r in got.collect()} == {("s1", "altered"), ("s2", "extra")}
    assert spark.read.text(path, recursiveFileLookup=True).where(F.col("value") != "second").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_files_are_read_from_few_folders(spark):
    v = Source(spark, "/root/testdata/sf0.001")
    path = q.one_file_each(v, q.stems(v).select("stem", F.col("filename").alias("value")), q.work(v, "few"), "mp3")
    assert files.media_files(spark, path).count() == q.stems(v).count() and len(os.listdir(path)) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_annotation_files_lie_in_few_folders(spark, monkeypatch):
    from spinlattice.catalog_queries import QUERIES

    read, seen = files.jams, []
    monkeypatch.setattr(q.files, "jams", lambda spark, path: seen.append(path) or read(spark, path))
    assert QUERIES["a07_jams"](spark, "/root/testdata/sf0.001").count() == 10
    assert len(os.listdir(seen[0])) == 1 and sum(len(names) for _, _, names in os.walk(seen[0])) == 10
