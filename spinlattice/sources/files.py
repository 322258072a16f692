"""File listings, label exports, collection XML and annotation sets as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import catalog
from ..shared import materialize

c = F.col
# fixed values: media file extensions
MEDIA = ["mp3", "wav", "flac", "ogg", "oga", "opus", "aiff", "aif", "m4a", "aac", "wma", "alac", "mkv", "mp4", "mov", "webm", "m4v", "avi", "flv", "mpg", "mpeg", "ts", "3gp"]
UNREAD = "_unread"
LABELS = "Title string, Artist string, Key string, Tempo string, Genre string, Album string, Grouping string, `Date Added` string, Location string, Comment string, Year string, `Overall Volume` string, Energy string, CuePoints string, ClippedPeaks string"
ENTRY = "_TITLE string, _ARTIST string, LOCATION struct<_FILE:string,_DIR:string>, MUSICAL_KEY struct<_VALUE:int>, TEMPO struct<_BPM:double>"
JAMS = "annotations array<struct<namespace:string,data:array<struct<time:double,duration:double,confidence:double,value:string>>>>, file_metadata struct<title:string,duration:double>"


def media_name(path: Column) -> tuple[Column, Column]:
    """filename and lower-case extension of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension")


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """A1: path, filename, extension and size of media files below a folder; contents are never read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", c("length").alias("file_size"), c("modificationTime").alias("modified"))
    return got.select("path", *media_name(c("path")), "file_size", "modified").where(c("extension").isin(*MEDIA))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """A3: typed label rows; rows without a location drop, a tempo that is no positive number is null."""
    raw = spark.read.schema(LABELS).csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"')
    bpm = c("Tempo").try_cast("double")
    return raw.where(F.trim(F.coalesce("Location", F.lit(""))) != "").select(c("Title").alias("title"), c("Artist").alias("artist"), F.trim("Key").alias("key"), F.when(bpm > 0, bpm).alias("bpm"), c("Genre").alias("genre_raw"), c("Energy").try_cast("int").alias("energy"), c("Location").alias("location"), F.lower(F.regexp_extract("Location", r"\.([^.\\/]+)$", 1)).alias("extension"))


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """A4: every record of a tag export, readable or not: file, row (its number in the file, from 1), location, key, energy and genre (null where
    blank or no number), and ``unread``, the text of a record with too many or too few fields. The text is parsed once, into the
    shared folder; a file with quoted line feeds is one task's work."""
    raw = spark.read.schema(f"{LABELS}, {UNREAD} string").csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"', columnNameOfCorruptRecord=UNREAD)
    at = F.monotonically_increasing_id().alias("at")
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    kept = raw.select(
        c("_metadata.file_path").alias("file"), at, "Title", F.when(c(UNREAD).isNull(), c("Location")).alias("location"), blank("Key").alias("key"),
        F.trim("Energy").try_cast("int").alias("energy"), blank("Genre").alias("genre"), c(UNREAD).alias("unread"),
    )
    rows = materialize(kept, "label-rows")
    first = rows.groupBy("file").agg(F.min("at").alias("first"))
    return rows.join(first, "file").withColumn("row", c("at") - c("first") + 1).drop("at", "first")


#: What an import makes of a table of opinions.
OPINION = ["track_id", "source", "key_camelot", "bpm", "energy", "confidence"]


def tag_opinions(tags: DataFrame, source: str) -> DataFrame:
    """A4, A5: the opinions of imported tags (track_id, key_camelot, bpm, energy, at), certain by definition."""
    return tags.select("track_id", F.lit(source).alias("source"), "key_camelot", c("bpm").cast("double").alias("bpm"), c("energy").cast("int").alias("energy"), F.lit(1.0).alias("confidence"), "at")


def _with_opinions(opinions: DataFrame, new: DataFrame) -> DataFrame:
    """The opinions after an import: one of a track and source gives way whole, nulls included; those of other sources stay."""
    lacks = [F.lit(None).cast("int").alias("energy")] if "energy" not in opinions.columns else []
    state = opinions.select("*", *lacks).select(*OPINION, F.lit(None).cast(new.schema["at"].dataType).alias("at"))
    return catalog.upsert(state, new, ["track_id", "source"], "at").drop("at")


def collection_xml(spark: SparkSession, path: str) -> DataFrame:
    """A5: every entry of a collection: at (its place in the file), title, artist, location (null where it names no file), wheel code and tempo."""
    raw = spark.read.format("xml").option("rowTag", "ENTRY").schema(ENTRY).load(path)
    at = F.struct(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    folder = text.collection_dir(F.coalesce(c("LOCATION._DIR"), F.lit("")))
    return raw.select(at.alias("at"), c("_TITLE").alias("title"), c("_ARTIST").alias("artist"), F.concat(folder, c("LOCATION._FILE")).alias("location"), keys.xml_key(c("MUSICAL_KEY._VALUE")).alias("key_camelot"), c("TEMPO._BPM").alias("bpm"))


def import_labels(spark: SparkSession, path: str, tracks: DataFrame, opinions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4: a tag export into the catalog: the tracks with the tags' key, energy and genre (tag_key, tag_energy, genre), the opinions with source
    tagcsv, and the report.

    A record means the tracks of its path, with either slash; without any, all tracks of its file name, in any case. Of several
    records of a track the last counts, in order of files and rows, with its blanks: they clear what was there. Records without a location
    or that cannot be read are counted and mean no track. Each side is reduced to a row a key before they meet, so a
    name that many records and many tracks share multiplies nothing."""
    rows = label_rows(spark, path).withColumn("at", F.struct("file", "row"))
    lib = tracks.select("track_id", text.normalize_path(c("file_path")).alias("path_key"), F.lower("filename").alias("name_key"))
    alone = F.concat(F.lit("\0"), F.xxhash64("at"))  # records without a location meet nothing, and not each other
    named = rows.withColumns({"path_key": F.coalesce(text.normalize_path(c("location")), alone), "name_key": F.coalesce(F.lower(text.basename(c("location"))), alone)})
    by_path = named.join(lib.select("path_key", F.lit(True).alias("at_path")).distinct(), "path_key", "left")
    met = by_path.join(lib.select("name_key", F.lit(True).alias("at_name")).distinct(), "name_key", "left")
    tag = F.struct("at", c("key").alias("key_camelot"), "energy", "genre")
    last = lambda some, key: some.groupBy(key).agg(F.max_by(tag, "at").alias(f"of_{key}"))
    told = lib.join(last(met.where("at_path"), "path_key"), "path_key", "left").join(last(met.where("at_path is null and at_name"), "name_key"), "name_key", "left")
    later = F.when(c("of_name_key").isNull() | (c("of_path_key.at") > c("of_name_key.at")), c("of_path_key")).otherwise(c("of_name_key"))
    tags = told.select("track_id", later.alias("t")).where("t is not null").select("track_id", "t.*", F.lit(None).cast("double").alias("bpm"))
    known = tracks.columns
    state = tracks.select("*", *(F.lit(None).cast(t).alias(x) for x, t in (("tag_key", "string"), ("tag_energy", "int"), ("genre", "string")) if x not in known))
    new = tags.select("track_id", c("key_camelot").alias("tag_key"), c("energy").alias("tag_energy"), "genre")
    report = catalog.import_report(met.select("row", F.coalesce("at_path", "at_name").isNotNull().alias("matched"), "unread"))
    return catalog.update_columns(state, new, ["tag_key", "tag_energy", "genre"], True), _with_opinions(opinions, tag_opinions(tags, "tagcsv")), report


def import_collection(spark: SparkSession, path: str, tracks: DataFrame, opinions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: a collection into the catalog: the opinions with source djxml, and the report. Entries mean the track of their path, else of their path
    with either slash, else the first of their file name; of several of a track the last counts; entries without a file are
    counted and mean none."""
    rows = materialize(collection_xml(spark, path), "collection")
    matched = catalog.match_imports(rows.withColumn("row_id", c("at")), tracks)
    tags = matched.where("track_id is not null").select("track_id", "at", "key_camelot", "bpm", F.lit(None).cast("int").alias("energy"))
    report = catalog.import_report(matched.select(F.lit(0).alias("row"), c("track_id").isNotNull().alias("matched"), F.lit(None).cast("string").alias("unread")))
    return _with_opinions(opinions, tag_opinions(tags, "djxml")), report


def stem_of(path: Column) -> Column:
    """What a file is about: its folder's value where that is ``stem=value``, as partitioned writers name folders, else its name without extension."""
    folder = F.regexp_extract(path, "/stem=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1))


def _whole(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    got = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return got.select(stem_of(c("_metadata.file_path")).alias("stem"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def annotation_folder(spark: SparkSession, folder: str, audio: DataFrame, suffixes: tuple[str, str] = (".key", ".genre")) -> DataFrame:
    """A row for each key file with its genre and whether the audio listing (path) has the stem."""
    key, genre = _whole(spark, folder, suffixes[0]), _whole(spark, folder, suffixes[1])
    heard = audio.select(stem_of(c("path")).alias("stem"), F.lit(True).alias("_a")).distinct()
    got = key.withColumnRenamed("value", "key_name").join(genre.withColumnRenamed("value", "genre_raw"), "stem", "left").join(heard, "stem", "left")
    t, m = keys.parse_standard(c("key_name"))
    return got.select("stem", "key_name", "genre_raw", t.alias("tonic"), m.alias("is_major"), F.when(c("_a").isNull(), "missing_file").otherwise("ready").alias("status"))


def jams(spark: SparkSession, path: str) -> DataFrame:
    """Stem, key, genre, duration and confidence of annotation JSON files, one a file; the first of several values of a kind counts."""
    raw = spark.read.schema(JAMS).option("recursiveFileLookup", True).json(path, multiLine=True)
    raw = raw.select(stem_of(c("_metadata.file_path")).alias("stem"), c("file_metadata.duration").alias("duration"), "annotations")
    kind = lambda ns: F.get(F.flatten(F.transform(F.filter("annotations", lambda a: a["namespace"] == ns), lambda a: a["data"])), F.lit(0))
    return raw.select("stem", "duration", kind("key_mode")["value"].alias("key"), kind("key_mode")["confidence"].alias("confidence"), kind("tag_open")["value"].alias("genre_raw"))


def annotation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """An ID, its alternatives ``F minor / G# major`` with their ordinal, and the confidence."""
    raw = spark.read.schema("id string, manual_key string, confidence double").csv(path, sep="\t", header=True)
    each = raw.select("id", "confidence", F.posexplode_outer(F.split("manual_key", r"\s*/\s*")).alias("ordinal", "key_name"))
    t, m = keys.parse_standard(c("key_name"))
    return each.select("id", "confidence", "ordinal", "key_name", t.alias("tonic"), m.alias("is_major"))


def integrity(spark: SparkSession, audio: str, sums: str, suffix: str = "") -> DataFrame:
    """Stem and status of every stem that has a file or a stored MD5: intact, altered, missing (a sum without a file) or extra (a file without a
    sum; nor can one be read from a sum's text without 32 hexadecimal digits). Spark passes over files of no bytes. The digest is of one file at a time in a task."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(audio)
    files = read.select(stem_of(c("path")).alias("stem"), F.md5("content").alias("actual"))
    text_ = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*").text(sums, wholetext=True)
    want = text_.select(stem_of(c("_metadata.file_path")).alias("stem"), F.lower(F.nullif(F.regexp_extract("value", "([0-9a-fA-F]{32})", 1), F.lit(""))).alias("expected"))
    status = F.when(c("actual").isNull(), "missing").when(c("expected").isNull(), "extra").when(c("actual") == c("expected"), "intact").otherwise("altered")
    return want.join(files, "stem", "full_outer").select("stem", status.alias("status"))
