"""Sources and streams (A, J) over the given tables: written to the shared folder, read back by the library, compared with SQL on the tables."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..shared import file_system, materialize, new_path, together
from ..sources import files
from ..sources.tables import KeyedTable
from ..streaming import jobs
from .registry import query, r6

c = F.col


def work(v, name):
    """A new folder that driver and executors share."""
    return new_path(v.spark, name)


#: What a tag export holds for each track, as (condition, place among its records, location, key, energy, genre, file). Every 31st has no location,
#: every third is named by file name alone, every third with backslashes; some are repeated with other tags, in this file or the last.
RECORDS = [
    ("true", 0, "CASE WHEN track_id % 31 = 0 THEN ' ' WHEN track_id % 3 = 0 THEN concat('D:/else/', filename) WHEN track_id % 3 = 1 THEN replace(file_path, '/', '\\') ELSE file_path END",
     "CASE WHEN track_id % 8 = 0 THEN '' ELSE key_camelot END", "CASE WHEN track_id % 5 = 0 THEN 'n/a' ELSE CAST(energy_level AS STRING) END", "CASE WHEN track_id % 6 = 0 THEN ' ' ELSE genre_raw END", "track_id % 4"),
    ("track_id % 5 = 1", 1, "file_path", "'1A'", "'3'", "'again'", "track_id % 4"),
    ("track_id % 10 = 3", 2, "concat('/none/', CAST(track_id AS STRING), '.mp3')", "'5A'", "'4'", "'none'", "track_id % 4"),
    ("track_id % 40 = 7", 3, "concat('X:\\other\\', upper(filename))", "'2B'", "' 5 '", "'by name'", "track_id % 4"),
    ("track_id % 50 = 9", 4, "file_path", "'3B'", "''", "''", "3"),
]


def records(dialect):
    """The export's records as SQL: p (its file), ord (its order there), and the fields; ``short`` ones hold two fields only."""
    fix = (lambda x: x.replace("\\", "\\\\")) if dialect == "spark" else (lambda x: x)
    parts = [
        f"SELECT CAST({file} AS INT) AS p, track_id * 10 + {k} AS ord, track_id, {k} AS kind, title, artist, {fix(place)} AS location, {key} AS key, "
        f"CASE WHEN track_id % 7 = 0 THEN '0' ELSE CAST(bpm AS STRING) END AS tempo, {energy} AS energy, {genre} AS genre FROM v_tracks WHERE {where}"
        for where, k, place, key, energy, genre, file in RECORDS
    ]
    none = "CAST(NULL AS STRING)"
    parts.append(f"SELECT CAST(track_id % 4 AS INT), track_id * 10 + 5, track_id, 5, concat('short,', CAST(track_id AS STRING)), {none}, {none}, {none}, {none}, {none}, {none} FROM v_tracks WHERE track_id % 25 = 4")
    return "\nUNION ALL ".join(parts)


def labels(v):
    """The export as files of lines, p=0 to p=3, each with its header."""
    some = F.lit(None).cast("string")
    fields = [c(x) for x in ("title", "artist", "key", "tempo", "genre")] + [some] * 3 + [c("location")] + [some] * 3 + [c("energy"), some, some]
    line = F.to_csv(F.struct(*(x.alias(f"f{i}") for i, x in enumerate(fields))), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    got = v.spark.sql(records("spark").replace("v_tracks", "{t}"), t=v("v_tracks")).select("p", "ord", F.when(c("kind") == 5, c("title")).otherwise(line).alias("value"))
    head = v.spark.range(4).select(c("id").cast("int").alias("p"), F.lit(-1).cast("long").alias("ord"), F.lit(",".join(v.spark.createDataFrame([], files.LABELS).columns)).alias("value"))
    got.unionByName(head).repartition(4, "p").sortWithinPartitions("p", "ord").select("p", "value").write.partitionBy("p").text(path := work(v, "labels"))
    return path


# the SQL side, from the rules: rows are numbered a file, a record means its path's track or else its file name's, the last counts
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY p ORDER BY ord) AS nr, CASE WHEN kind NOT IN (2, 5) AND trim(location) <> '' THEN track_id END AS means FROM ({records('duckdb')}) r"
LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY means ORDER BY p DESC, nr DESC) AS latest FROM ({NUMBERED}) n WHERE means IS NOT NULL) l WHERE latest = 1"
TAGS = f"SELECT means AS track_id, nullif(trim(key), '') AS tag_key, TRY_CAST(trim(energy) AS INT) AS tag_energy, nullif(trim(genre), '') AS genre FROM ({LAST}) t"


@query("a03_label_csv", f"""SELECT title, artist, nullif(trim(key), '') AS key, CASE WHEN TRY_CAST(tempo AS DOUBLE) > 0 THEN TRY_CAST(tempo AS DOUBLE) END AS bpm, nullif(genre, '') AS genre_raw, TRY_CAST(trim(energy) AS INT) AS energy, location, 'mp3' AS extension
FROM ({records('duckdb')}) r WHERE trim(location) <> '' AND kind <> 5""")  # fmt: skip
def _(v):
    return files.label_csv(v.spark, labels(v))


def told(v, opinions=None):
    return (v("v_opinions") if opinions is None else opinions).select("track_id", "source", "key_camelot", "bpm", "energy", c("confidence").cast("double").alias("confidence"))


KEPT = "SELECT track_id, source, key_camelot, round(bpm, 6) AS bpm, CAST(energy AS INT) AS energy, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM v_opinions o WHERE NOT (source = '{0}' AND EXISTS (SELECT 1 FROM ({1}) t WHERE t.track_id = o.track_id))"


@query("a04_tag_import", f"{KEPT.format('tagcsv', TAGS)} UNION ALL SELECT track_id, 'tagcsv', tag_key, NULL, tag_energy, 1.0 FROM ({TAGS}) x")
def _(v):
    _, opinions, _ = files.import_labels(v.spark, labels(v), v("v_tracks"), told(v))
    return opinions.withColumn("bpm", r6(c("bpm"))).withColumn("confidence", r6(c("confidence")))


@query("a04_tag_columns", f"SELECT t.track_id, x.tag_key, x.tag_energy, x.genre FROM v_tracks t LEFT JOIN ({TAGS}) x ON x.track_id = t.track_id")
def _(v):
    tracks, _, _ = files.import_labels(v.spark, labels(v), v("v_tracks"), told(v))
    return tracks.select("track_id", "tag_key", "tag_energy", "genre")


@query("a04_tag_report", f"""SELECT count(*) AS total, count(means) AS matched, count(*) - count(means) AS unmatched,
coalesce(string_agg(concat('Row ', CAST(nr AS STRING), ': parse error: ', title), '; ' ORDER BY nr, title) FILTER (kind = 5), '') AS errors FROM ({NUMBERED}) x""")  # fmt: skip
def _(v):
    _, _, report = files.import_labels(v.spark, labels(v), v("v_tracks"), told(v))
    return report.select("total", "matched", "unmatched", F.array_join("errors", "; ").alias("errors"))


XML_CODES = ["8B", "9B", "10B", "11B", "12B", "1B", "2B", "3B", "4B", "5B", "6B", "7B", "5A", "6A", "7A", "8A", "9A", "10A", "11A", "12A", "1A", "2A", "3A", "4A"]
#: Entries: every 13th names no file, every seventh comes twice, the second with the next code.
COLLECTED = f"SELECT track_id, {XML_CODES}[CAST((track_id + CASE WHEN track_id % 7 = 0 THEN 1 ELSE 0 END) % 24 AS INT) + 1] AS key_camelot, bpm FROM v_tracks WHERE track_id % 13 <> 0"


def collection(v):
    folder = F.regexp_extract("file_path", "^(.*/)[^/]*$", 1)
    where = F.when(c("track_id") % 3 == 0, F.concat(F.lit("file://localhost/"), folder)).when(c("track_id") % 3 == 1, F.replace(folder, F.lit("/"), F.lit("/:")))
    twice = F.explode(F.when(c("track_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = v("v_tracks").select("*", twice.alias("again")).repartitionByRange(4, "track_id").sortWithinPartitions("track_id", "again").select(
        c("title").alias("_TITLE"), c("artist").alias("_ARTIST"), F.when(c("track_id") % 13 != 0, F.struct(c("filename").alias("_FILE"), where.alias("_DIR"))).alias("LOCATION"),
        F.struct(((c("track_id") + c("again")) % 24).cast("int").alias("_VALUE")).alias("MUSICAL_KEY"), F.struct(c("bpm").alias("_BPM")).alias("TEMPO"),
    )
    rows.write.format("xml").option("rowTag", "ENTRY").option("rootTag", "COLLECTION").save(path := work(v, "collection"))
    return path


@query("a05_collection_import", f"{KEPT.format('djxml', COLLECTED)} UNION ALL SELECT track_id, 'djxml', key_camelot, round(bpm, 6), NULL, 1.0 FROM ({COLLECTED}) x")
def _(v):
    opinions, _ = files.import_collection(v.spark, collection(v), v("v_tracks"), told(v))
    return opinions.withColumn("bpm", r6(c("bpm"))).withColumn("confidence", r6(c("confidence")))


@query("a05_collection_report", """SELECT count(*) AS total, count(*) FILTER (WHERE track_id % 13 <> 0) AS matched, count(*) FILTER (WHERE track_id % 13 = 0) AS unmatched
FROM (SELECT track_id FROM v_tracks UNION ALL SELECT track_id FROM v_tracks WHERE track_id % 7 = 0) x""")  # fmt: skip
def _(v):
    _, report = files.import_collection(v.spark, collection(v), v("v_tracks"), told(v))
    return report.select("total", "matched", "unmatched")


#: Two alternatives for every fourth track, none for every ninth.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
ALTERNATIVES = f"""SELECT track_id, CAST(track_id % 3 AS DOUBLE) AS confidence, 0 AS ordinal, CAST(track_id % 12 AS INT) AS tonic, true AS is_major FROM v_tracks WHERE track_id % 9 <> 0
UNION ALL SELECT track_id, CAST(track_id % 3 AS DOUBLE), 1, CAST((track_id + 5) % 12 AS INT), false FROM v_tracks WHERE track_id % 9 <> 0 AND track_id % 4 = 0
UNION ALL SELECT track_id, CAST(track_id % 3 AS DOUBLE), NULL, NULL, NULL FROM v_tracks WHERE track_id % 9 = 0"""


@query("a08_annotation_table", f"SELECT CAST(track_id AS STRING) AS id, confidence, ordinal, tonic, is_major FROM ({ALTERNATIVES}) x")
def _(v):
    note = lambda k: F.get(F.array(*map(F.lit, NOTES)), (k % 12).cast("int"))
    one = F.concat(note(c("track_id")), F.lit(" major"))
    key = F.when(c("track_id") % 9 == 0, None).when(c("track_id") % 4 == 0, F.concat(one, F.lit(" / "), note(c("track_id") + 5), F.lit(" minor"))).otherwise(one)
    rows = v("v_tracks").select(c("track_id").cast("string").alias("ID"), key.alias("MANUAL KEY"), (c("track_id") % 3).alias("C"))
    rows.write.csv(path := work(v, "annotations"), sep="\t", header=True)
    return files.annotation_tsv(v.spark, path).select("id", "confidence", "ordinal", "tonic", "is_major")


def dealt(v, rows, order, parts=4):
    """``rows`` as that many files or fewer, in order of time of writing, for a stream that takes one file a batch."""
    source, schema = work(v, "stream"), rows.schema
    rows = materialize(rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts))), "stream-rows")
    for k in range(parts):
        rows.where(c("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(source)
    return v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


#: Folders of media files made of the tracks: two kinds of file and one that is no media file, four of each.
KINDS = [("mp3", 0), ("wav", 1), ("txt", 2)]
LISTED = "SELECT CASE track_id % 3 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' ELSE 'txt' END AS extension, CAST(track_id % 4 AS INT) AS part, track_id, concat(filename, chr(10)) AS line FROM v_tracks"


def media_folder(v):
    """``part=0`` to ``part=3`` below a folder, each with a file of lines for each kind."""
    path = work(v, "media")
    for kind, k in KINDS:
        rows = v("v_tracks").where(c("track_id") % 3 == k).select((c("track_id") % 4).cast("int").alias("part"), "filename").repartition(4, "part")
        rows.write.mode("append").partitionBy("part").option("extension", kind).option("quote", "").csv(path)
    return path


def part_of(path):
    return F.regexp_extract(path, "/part=([0-9]+)/", 1).cast("int").alias("part")


@query("a01_media_scan", f"SELECT extension, part, CAST(sum(strlen(line)) AS BIGINT) AS file_size FROM ({LISTED}) f WHERE extension <> 'txt' GROUP BY extension, part")
def _(v):
    return files.media_files(v.spark, media_folder(v)).select("extension", part_of(c("path")), "file_size")


#: Files that one task writes.
FILES_A_TASK = 500


def one_file_each(v, rows, path, kind):
    """``rows`` (stem, value) as a file each, its value and a line feed: ``stem.kind``, in a folder a task.

    The number of tasks is that of the files; a repartition left to Spark's own sizing is one task for any number of small rows. Spark's
    sinks start a process for every local file (its mode), so local files are written by the tasks themselves."""
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    dealt = rows.select("stem", "value").repartition(tasks, "stem")
    fs, _ = file_system(v.spark, path)
    if fs.getUri().getScheme() == "file":
        dealt.mapInArrow(_filed(path, kind), "n long").agg(F.sum("n")).collect()
    else:
        dealt.write.mode("append").partitionBy("stem").option("extension", kind).option("quote", "").option("escape", "").csv(path)
    return path


def _filed(path, kind):
    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs as arrow_fs
        from pyspark import TaskContext

        store, root = arrow_fs.FileSystem.from_uri(path)
        folder = f"{root}/{TaskContext.get().partitionId()}"
        store.create_dir(folder)
        for batch in batches:
            for stem, value in zip(batch["stem"].to_pylist(), batch["value"].to_pylist(), strict=True):
                draft = f"{folder}/_{uuid.uuid4().hex}"  # readers pass over it; a task that runs again replaces the file
                with store.open_output_stream(draft) as out:
                    out.write(f"{value or ''}\n".encode())
                store.move(draft, f"{folder}/{stem}.{kind}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return write


def stems(v):
    """Every 20th track; a file each is what the sources read."""
    return v("v_tracks").where("track_id % 20 = 0").select(F.concat(F.lit("s"), c("track_id").cast("string")).alias("stem"), "track_id", "genre_raw", "filename", "bpm", "key_confidence")


STEMS = "SELECT concat('s', CAST(track_id AS STRING)) AS stem, track_id, genre_raw, filename, bpm, key_confidence FROM v_tracks WHERE track_id % 20 = 0"


@query("a06_annotation_folder", f"""SELECT stem, {NOTES}[CAST(track_id / 20 % 12 AS INT) + 1] AS note, CASE WHEN track_id % 60 <> 0 THEN genre_raw END AS genre_raw, CAST(floor(track_id / 20) % 12 AS INT) AS tonic,
track_id % 40 = 0 AS is_major, CASE WHEN track_id % 100 = 0 THEN 'missing_file' ELSE 'ready' END AS status FROM ({STEMS}) x""".replace("CAST(track_id / 20 % 12 AS INT)", "CAST(floor(track_id / 20) % 12 AS INT)"))  # fmt: skip
def _(v):
    some, note = stems(v), F.get(F.array(*map(F.lit, NOTES)), (F.floor(c("track_id") / 20) % 12).cast("int"))
    named = F.concat(note, F.when(c("track_id") % 40 == 0, " major").otherwise(" minor"))
    folder = work(v, "annotations")
    for kind, rows in (("key", some.select("stem", named.alias("value"))), ("gnr", some.where("track_id % 60 <> 0").select("stem", c("genre_raw").alias("value")))):
        one_file_each(v, rows, folder, kind)
    audio = one_file_each(v, some.where("track_id % 100 <> 0").select("stem", c("filename").alias("value")), work(v, "audio"), "mp3")
    got = files.annotation_folder(v.spark, folder, files.media_files(v.spark, audio), (".key", ".gnr"))
    return got.select("stem", F.split("key_name", " ")[0].alias("note"), "genre_raw", "tonic", "is_major", "status")


@query("a07_jams", f"SELECT stem, round(bpm, 6) AS duration, CASE WHEN track_id % 60 <> 0 THEN concat({NOTES}[CAST(track_id % 12 AS INT) + 1], ':minor') END AS key, CASE WHEN track_id % 60 <> 0 THEN round(key_confidence, 6) END AS confidence, genre_raw FROM ({STEMS}) x")
def _(v):
    one = lambda ns, value, sure: F.struct(F.lit(ns).alias("namespace"), F.array(*(F.struct(F.lit(0.0).alias("time"), F.lit(1.0).alias("duration"), sure.alias("confidence"), x.alias("value")) for x in value)).alias("data"))
    key = F.concat(F.get(F.array(*map(F.lit, NOTES)), (c("track_id") % 12).cast("int")), F.lit(":minor"))
    both = F.array(one("tag_open", [c("genre_raw"), F.lit("second")], F.lit(None).cast("double")), one("key_mode", [key, F.lit("C:major")], c("key_confidence")))
    whole = F.struct(F.when(c("track_id") % 60 == 0, F.slice(both, 1, 1)).otherwise(both).alias("annotations"), F.struct(c("filename").alias("title"), c("bpm").alias("duration")).alias("file_metadata"))
    got = files.jams(v.spark, one_file_each(v, stems(v).select("stem", F.to_json(whole).alias("value")), work(v, "jams"), "jams"))
    return got.withColumns({"duration": r6(c("duration")), "confidence": r6(c("confidence"))})


@query("a09_integrity", f"SELECT stem, CASE WHEN track_id % 100 = 0 THEN 'missing' WHEN track_id % 80 = 0 THEN 'extra' WHEN track_id % 60 = 0 THEN 'altered' ELSE 'intact' END AS status FROM ({STEMS}) x")
def _(v):
    some = stems(v)
    audio = one_file_each(v, some.where("track_id % 100 <> 0").select("stem", F.concat("filename", F.when(c("track_id") % 60 == 0, "x").otherwise("")).alias("value")), work(v, "audio"), "wav")
    sums = one_file_each(v, some.where("track_id % 80 <> 0 or track_id % 100 = 0").select("stem", F.concat(F.md5(F.concat("filename", F.lit("\n"))), F.lit("  a.wav")).alias("value")), work(v, "sums"), "md5")
    return files.integrity(v.spark, audio, sums, ".wav")


@query("j01_discover", f"SELECT extension, part, CAST(sum(strlen(line)) AS BIGINT) AS file_size, CASE WHEN extension = 'wav' THEN 'analyzed' ELSE 'pending' END AS status FROM ({LISTED}) f WHERE extension <> 'txt' GROUP BY extension, part")
def _(v):
    folder = media_folder(v)
    known = files.media_files(v.spark, folder).where("extension = 'wav'").select(c("path").alias("file_path"), F.lit("old").alias("filename"), F.lit(0).cast("long").alias("file_size"), F.lit("analyzed").alias("status"))
    catalog = KeyedTable.create(known, work(v, "catalog"), "file_path", rows_per_file=2)
    jobs.run(jobs.listing(v.spark, folder, per_batch=1), lambda rows, n: jobs.discover(rows, catalog, "scan", n), work(v, "progress"))
    return catalog.read().where("filename <> 'old'").select(files.media_name(c("file_path"))[1], part_of(c("file_path")), "file_size", "status")


#: Results: all tag opinions, and for every third track a later one, dealt to batches in no order of time.
RESULTS = """SELECT track_id, key_camelot, bpm, CAST(confidence AS DOUBLE) AS confidence, CAST(created_at AS TIMESTAMP) AS made FROM v_opinions WHERE source = 'tagcsv'
UNION ALL SELECT track_id, '7B', 99.5, CAST(0.5 AS DOUBLE), CAST('2030-01-01' AS TIMESTAMP) FROM v_opinions WHERE source = 'tagcsv' AND track_id % 3 = 0"""
NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY made DESC) AS r FROM ({RESULTS}) x) y WHERE r = 1"


def results_stored(v):
    given = materialize(v("v_opinions"), "opinions")
    results = v.spark.sql(RESULTS.replace("v_opinions", "{o}"), o=given).withColumnRenamed("made", "at")
    opened = told(v, given).drop("energy").withColumn("at", F.lit(None).cast("timestamp"))
    library = v("v_tracks").select("track_id", "key_camelot", "bpm", "status", F.lit(None).cast("timestamp").alias("analyzed_at"))
    stream, opinions, tracks = together(
        v.spark,
        lambda: dealt(v, results, ["track_id", "at"]),
        lambda: KeyedTable.create(opened, work(v, "opinions"), "track_id", rows_per_file=1_000_000),
        lambda: KeyedTable.create(library, work(v, "tracks"), "track_id"),
    )
    jobs.run(stream, lambda rows, n: jobs.store_results(rows, tracks, opinions, "results", n), work(v, "progress"))
    return tracks, opinions


@query("j02_apply_results", f"SELECT track_id, source, key_camelot, round(bpm, 6) AS bpm FROM v_opinions o WHERE NOT (source = 'engine' AND EXISTS (SELECT 1 FROM v_opinions r WHERE r.source = 'tagcsv' AND r.track_id = o.track_id)) UNION ALL SELECT track_id, 'engine', key_camelot, round(bpm, 6) FROM ({NEWEST}) n")
def _(v):
    return results_stored(v)[1].read().select("track_id", "source", "key_camelot", r6(c("bpm")).alias("bpm"))


@query("j02_tracks", f"SELECT t.track_id, CASE WHEN n.r = 1 THEN n.key_camelot ELSE t.key_camelot END AS key_camelot, round(CASE WHEN n.r = 1 THEN n.bpm ELSE t.bpm END, 6) AS bpm, CASE WHEN n.r = 1 THEN 'analyzed' ELSE t.status END AS status FROM v_tracks t LEFT JOIN ({NEWEST}) n ON n.track_id = t.track_id")
def _(v):
    return results_stored(v)[0].read().select("track_id", "key_camelot", r6(c("bpm")).alias("bpm"), "status")


@query("j03_throughput", "SELECT date_trunc('minute', ts) AS start, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, round(1000 / CAST(count(*) AS DOUBLE), 6) AS eta_minutes FROM v_progress GROUP BY 1")
def _(v):
    events = v("v_progress").select(c("ts").cast("timestamp").alias("ts"), "track_id", "failed")
    rate = jobs.throughput(dealt(v, events, ["track_id"]), 1000, late="3650 days").withColumn("minute", F.unix_seconds("start"))
    held = KeyedTable.create(v.spark.createDataFrame([], rate.schema), work(v, "rates"), "minute")
    jobs.run(rate, lambda rows, n: jobs.merge_updates(rows, held, "rates", n), work(v, "progress"), "update")
    return held.read().select("n", "failed", r6(c("eta_minutes")).alias("eta_minutes"), c("start").cast("timestamp_ntz").alias("start"))


@query("j04_latest", "SELECT track_id, max(ts) AS ts, arg_max(event_id, row(ts, event_id)) AS event_id FROM (SELECT user_id AS track_id, ts, event_id FROM events) e GROUP BY track_id")
def _(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").select(c("user_id").alias("track_id"), "ts", "event_id")
    newest = jobs.latest(dealt(v, events, ["event_id"]))
    held = KeyedTable.create(v.spark.createDataFrame([], newest.schema), work(v, "latest"), "track_id")
    jobs.run(newest, lambda rows, n: jobs.merge_updates(rows, held, "latest", n), work(v, "progress"), "update")
    return held.read()


@query("j05_tap_tempo", """SELECT session_id, ts, CASE WHEN m > 0 THEN CAST(floor(least(300.0, greatest(20.0, 60.0 / m)) + 0.5) AS BIGINT) END AS bpm FROM (
SELECT session_id, ts, avg(gap) OVER (PARTITION BY session_id, run ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM (
SELECT session_id, ts, CASE WHEN gap <= 86400 THEN gap END AS gap, sum(CASE WHEN gap <= 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts) AS run FROM (
SELECT session_id, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY session_id ORDER BY ts) AS gap FROM (SELECT DISTINCT worker_id AS session_id, ts FROM v_progress) d) g) h) x""")
def _(v):
    """In batches without order of time: the watermark is wide enough for all, and a last tap of another session moves it past them."""
    taps = v("v_progress").select(c("worker_id").cast("long").alias("session_id"), c("ts").cast("timestamp").alias("ts")).distinct()
    stream = dealt(v, taps.unionByName(v.spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"))), ["session_id", "ts"], parts=3)
    tempo = jobs.tap_tempo(stream, late="3650 days", idle_s=86400.0)
    held = KeyedTable.create(v.spark.createDataFrame([], tempo.schema), work(v, "tempo"), "session_id")
    with store(v.spark, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        jobs.run(tempo, lambda rows, n: jobs.append_rows(rows, held, "tempo", n), work(v, "progress"))
    return held.read().where("session_id >= 0").withColumn("ts", c("ts").cast("timestamp_ntz"))


@contextmanager
def store(spark, provider):
    """The session's state store for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
