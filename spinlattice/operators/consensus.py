"""Opinions of several sources on a track's key and tempo, and their consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import upper_median

c = F.col
SOURCES = ["engine", "tagcsv", "djxml", "fingerprint"]


def consensus(opinions: DataFrame) -> DataFrame:
    """A row for each track with opinions.

    The modal key is the one with most sources, then the greatest confidence, then the least text; the tempo is the upper
    median, with the number of tempos within one of it. Two steps of grouping on the track, so the second needs no
    shuffle of opinions; a track has one opinion a source, which bounds its arrays.
    """
    by_key = opinions.groupBy("track_id", "key_camelot").agg(
        F.count("*").alias("n"), F.max("confidence").alias("best"), F.collect_list("bpm").alias("bpms"), F.collect_list(F.struct("source", "key_camelot", "bpm", "confidence")).alias("rows")
    )
    some = c("key_camelot").isNotNull()
    top = F.min(F.when(some, F.struct((-c("n")).alias("n"), (-F.coalesce("best", F.lit(-1.0))).alias("best"), c("key_camelot").alias("key"))))
    got = by_key.groupBy("track_id").agg(
        F.sum("n").alias("source_count"), top.alias("top"), F.sum(F.when(some, c("n"))).alias("keyed"), F.count_if(some).alias("distinct_keys"), F.flatten(F.collect_list("bpms")).alias("bpms"), F.array_sort(F.flatten(F.collect_list("rows"))).alias("opinions")
    )
    got = got.withColumn("bpm", upper_median(c("bpms")))
    status = F.when(F.coalesce("keyed", F.lit(0)) <= 1, "single").when(c("distinct_keys") == 1, "agreed").otherwise("contested")
    return got.select("track_id", "source_count", c("top.key").alias("key_camelot"), F.coalesce(-c("top.n"), F.lit(0)).alias("agreeing"), "bpm", F.size(F.filter("bpms", lambda x: F.abs(x - c("bpm")) <= 1)).alias("bpm_agreeing"), status.alias("status"), "opinions")


def consensus_for(ids: DataFrame, opinions: DataFrame) -> DataFrame:
    """Requested ids; those without opinions are unknown."""
    got = consensus(opinions.join(ids.select("track_id"), "track_id", "left_semi"))
    return ids.select("track_id").join(got, "track_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def contested(opinions: DataFrame, limit: int = 100) -> DataFrame:
    """Tracks with several keys, most first: a top-k."""
    n = opinions.groupBy("track_id").agg(F.count_distinct("key_camelot").alias("n_keys")).where("n_keys > 1")
    return n.orderBy(c("n_keys").desc(), "track_id").limit(limit)


def by_source(opinions: DataFrame) -> DataFrame:
    """A column a source, and whether those that have a key agree."""
    wide = opinions.groupBy("track_id").pivot("source", SOURCES).agg(F.first("key_camelot"))
    held = F.array_compact(F.array(*SOURCES))
    return wide.withColumn("agree", F.size(F.array_distinct(held)) == 1)


def validation(opinions: DataFrame) -> DataFrame:
    """L1: of tracks with both, how often engine and tag keys agree."""
    wide = opinions.groupBy("track_id").pivot("source", ["engine", "tagcsv"]).agg(F.first("key_camelot")).where("engine is not null and tagcsv is not null")
    return wide.agg(F.count("*").alias("n"), F.count_if(c("engine") == c("tagcsv")).alias("agree"), (F.avg(F.when(c("engine") == c("tagcsv"), 100.0).otherwise(0.0))).alias("percent"))


def recalibrate(opinions: DataFrame, truth: DataFrame) -> DataFrame:
    """L2: a source's weight is its squared accuracy against the truth keys (track_id, truth)."""
    hit = opinions.where("key_camelot is not null").join(truth.where("truth is not null"), "track_id")
    got = hit.groupBy("source").agg(F.avg(F.when(c("key_camelot") == c("truth"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))
    return got.withColumn("weight", F.pow("accuracy", F.lit(2.0)))


def gold_summary(gold: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks of the library, annotations and annotated tracks."""
    return gold.agg(F.count("*").alias("annotations"), F.count_distinct("track_id").alias("tracks")).crossJoin(tracks.agg(F.count("*").alias("total_tracks")))


def self_agreement(gold: DataFrame) -> DataFrame:
    """Of tracks that one annotator marked twice or more, the share with one answer; null if there are none."""
    per = gold.where("annotator_id = 'self'").groupBy("track_id").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", "tonic_pc", "key_mode")).alias("answers")).where("n >= 2")
    return per.agg(F.count("*").alias("tracks"), F.avg(F.when(c("answers") == 1, 1.0).otherwise(0.0)).alias("agreement"))


def mode_distribution(gold: DataFrame) -> DataFrame:
    """E5."""
    return gold.groupBy("key_mode").agg(F.count("*").alias("n"))


def training_stats(sessions: DataFrame) -> DataFrame:
    """Total, correct and percent, overall (null type) and by type, in one pass of grouping sets."""
    got = sessions.rollup("session_type").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return got.withColumn("percent", c("correct") / c("total") * 100)
