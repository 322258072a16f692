"""Playlists and set lists: fuzzy matching, flow texts, summaries, export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import upper_median  # noqa: F401
from ..shared import materialize

c = F.col


#: Library rows of one cell that meet a line in one task.
CELL = 2_000
#: Tokens of at most so many library tracks give a line a first likeness to beat; other lines start at 0.5.
RARE = 64


def join_cells(left: DataFrame, right: DataFrame, on: list[str], spread: str, most: int = CELL) -> DataFrame:
    """Inner join on ``on`` in which a cell with many rows of ``right`` is many tasks: these are dealt by ``spread`` to parts of about ``most``, and the
    cell's rows of ``left`` go to each part. Cells below that, nearly all, are one part and copied nowhere."""
    parts = F.ceil(F.count("*") / F.lit(most)).cast("int")
    hot = right.groupBy(*on).agg(parts.alias("_parts")).where("_parts > 1")  # at most a row for every ``most`` rows of ``right``
    known = lambda df: df.join(hot, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = known(right).withColumn("_part", F.pmod(F.xxhash64(spread), c("_parts")).cast("int")).drop("_parts")
    asked = known(left).withColumn("_part", F.explode(F.sequence(F.lit(0), c("_parts") - 1))).drop("_parts")
    return asked.join(dealt, [*on, "_part"]).drop("_part")


def match_setlist(lines: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """The library track of each line (title, artist): 0.6 max(title, file name similarity) + 0.4 artist similarity
    over 0.5, the best, the first by file name.

    A line's rarest token, if RARE tracks or fewer hold it, gives a likeness ``least`` that the best one has at least (else 0.5). Of n title tokens ordered
    by rarity (then text) a track whose title or file name is similar by t holds one of the first n - ceil(tn) + 1. Without a common artist token t is least / 0.6,
    at least 5/6: those tokens meet the track's own such ones of 5/6, and the shorter has 5/6 of the longer's tokens. With a common artist token
    t is (least - 0.4) / 0.6: those pairs meet on (artist token, title token). Both ways are lossless, and a line that has its own track meets few others. Rows bring their
    tokens along, so a pair is scored where it meets and only those over 0.5 go any further; cells that most of a library shares, such as an
    unknown artist and a common word, are split. Equal lines are matched once.
    """
    told = lines.select(*keys, F.coalesce("title", F.lit("")).alias("_t"), F.coalesce("artist", F.lit("")).alias("_a"))
    # the best, then the first by file name, then the least id
    order = F.struct((-c("similarity")).alias("s"), "filename", "track_id")
    some = setlist_pairs(told.select("_t", "_a").distinct(), library).withColumn("similarity", _likeness()).where("similarity > 0.5")
    best = some.select("_t", "_a", order.alias("m")).groupBy("_t", "_a").agg(F.min("m").alias("m"))
    return told.join(best, ["_t", "_a"]).select(*keys, c("m.track_id").alias("track_id"), (-c("m.s")).alias("similarity"))


def _likeness() -> Column:
    return 0.6 * F.greatest(text.jaccard(c("lt"), c("tt")), text.jaccard(c("lt"), c("tf"))) + 0.4 * text.jaccard(c("la"), c("ta"))


def setlist_pairs(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """Of distinct lines (_t, _a) and the library every pair that can be a line's best, with the tokens of both: see :func:`match_setlist`."""
    want = wanted.select("_t", "_a", text.tokens(c("_t")).alias("lt"), text.tokens(c("_a")).alias("la"))
    have = library.select("track_id", "filename", text.tokens(F.coalesce("title", F.lit(""))).alias("tt"), text.tokens(F.coalesce("artist", F.lit(""))).alias("ta"), text.tokens(F.coalesce("filename", F.lit(""))).alias("tf"))
    have = materialize(have, "set-library")
    held = have.select("*", F.explode(F.array_union("tt", "tf")).alias("token"))
    rarity = held.groupBy("token").agg(F.count("*").alias("n"))

    def ranked(df: DataFrame, array: str) -> DataFrame:
        """Rows with ``s``, an array's tokens by rarity."""
        each = df.select("*", F.explode(array).alias("token")).join(rarity, "token", "left")
        return each.groupBy(*df.columns).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("s"))

    def prefix(df: DataFrame, like: Column) -> DataFrame:
        """Rows of :func:`ranked` by the rarest tokens that one common to an array similar by ``like`` must be among."""
        shared = F.greatest(F.lit(1), F.ceil(F.size("s") * like - 1e-9).cast("int"))
        return df.select("*", F.explode(F.slice("s", F.lit(1), F.size("s") - shared + 1)).alias("x")).select(*(x for x in df.columns if x != "s"), "x.token")

    known = materialize(ranked(want, "lt"), "set-lines")
    rarest = F.get(F.filter("s", lambda x: (x["n"] > 0) & (x["n"] <= RARE)), F.lit(0))["token"]
    met = known.select("_t", "_a", "lt", "la", rarest.alias("token")).where("token is not null").join(held, "token")
    least = met.groupBy("_t", "_a").agg(F.max(_likeness()).alias("least"))
    known = known.join(least, ["_t", "_a"], "left").withColumn("least", F.greatest(F.lit(0.5), "least"))
    known = materialize(known, "set-least")
    pair = ["_t", "_a", "lt", "la", "track_id", "filename", "tt", "ta", "tf"]
    near = lambda x, y: 6 * F.least(F.size(x), F.size(y)) >= 5 * F.greatest(F.size(x), F.size(y))
    mine = prefix(known.where(c("least") <= 0.6 + 1e-9), F.greatest(F.lit(5 / 6), c("least") / 0.6))
    theirs = prefix(ranked(have, "tt"), F.lit(5 / 6)).unionByName(prefix(ranked(have, "tf"), F.lit(5 / 6)))
    alike = join_cells(mine, theirs, ["token"], "track_id").where(near("lt", "tt") | near("lt", "tf"))
    left = prefix(known.select("*", F.explode("la").alias("artist")), (c("least") - 0.4) / 0.6)
    right = held.select("*", F.explode("ta").alias("artist"))
    return alike.select(*pair).unionByName(join_cells(left, right, ["artist", "token"], "track_id").select(*pair))


def flow(ordered: DataFrame) -> DataFrame:
    """of (set_id, position, matched, key_camelot, bpm): flow text and transition sentence of each line."""
    w = Window.partitionBy("set_id").orderBy("position")
    k, before, first = c("key_camelot"), F.lag("key_camelot").over(w), F.row_number().over(w) == 1
    flow_ = F.when(first & k.isNotNull(), F.concat(F.lit("Opening: "), k)).when(first, "Opening (unmatched)").otherwise(F.concat(F.coalesce(before, F.lit("?")), F.lit(" → "), F.coalesce(k, F.lit("?"))))
    a, b = F.coalesce(before, F.lit("?")), F.coalesce(k, F.lit("?"))
    tempo = lambda x: F.coalesce(F.format_string("%.0f", F.rint(x)), F.lit("?"))
    bpms = F.concat(F.when(F.lag("bpm").over(w).isNull(), "?").otherwise(tempo(F.lag("bpm").over(w))), F.lit(" → "), F.when(c("bpm").isNull(), "?").otherwise(tempo(c("bpm"))))
    change = F.when(a == b, F.concat(F.lit("Same key ("), a, F.lit(")"))).otherwise(F.concat(F.lit("Key shift "), a, F.lit(" → "), b))
    both = c("matched") & F.lag("matched").over(w)
    sentence = F.when(first, None).when(both, F.concat(F.lit("Track "), a, F.lit(" → "), b, F.lit(": "), change, F.lit(", BPM "), bpms)).otherwise("Transition (unmatched tracks)")
    return ordered.select("set_id", "position", flow_.alias("flow"), sentence.alias("transition"))


def set_summary(ordered: DataFrame) -> DataFrame:
    """Of (set_id, position, matched, key_camelot, bpm, energy_level): counts, key flow, tempo range, energy arc.

    The lists are one set's lines."""
    listed = F.array_sort(F.collect_list(F.struct("position", "key_camelot", "energy_level")))
    got = ordered.groupBy("set_id").agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.min("bpm").alias("bpm_min"), F.max("bpm").alias("bpm_max"), listed.alias("l"))
    held = lambda x: F.array_compact(F.transform("l", lambda r: r[x]))
    return got.select("set_id", "total", "matched", (c("total") - c("matched")).alias("unmatched"), held("key_camelot").alias("key_flow"), "bpm_min", "bpm_max", held("energy_level").alias("energy_arc"))


def renumber(rows: DataFrame, by: str = "playlist_id", order: list[str] | None = None) -> DataFrame:
    """positions 0, 1, 2, ... again after rows went or moved."""
    w = Window.partitionBy(by).orderBy(*(order or ["position"]))
    return rows.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def key_journey(ordered: DataFrame) -> DataFrame:
    """F8: a playlist's known keys in order."""
    listed = F.array_sort(F.collect_list(F.when(c("key_camelot").isNotNull(), F.struct("position", "key_camelot"))))
    return ordered.groupBy("playlist_id").agg(F.transform(listed, lambda r: r["key_camelot"]).alias("journey"))


def trajectory(ordered: DataFrame) -> DataFrame:
    """For each row the fraction of the way through and the energy from 0 to 1."""
    w = Window.partitionBy("playlist_id")
    i = F.row_number().over(w.orderBy("position")) - 1
    n = F.count("*").over(w)
    return ordered.select("playlist_id", "position", "title", "key_camelot", "bpm", ((c("energy_level") - 1) / 9).alias("energy"), (i / F.greatest(n - 1, F.lit(1))).alias("fraction"))


def m3u8_lines(ordered: DataFrame, with_titles: bool = True) -> DataFrame:
    """A10: (playlist_id, at, line), ready to be written sorted by both: a header, then two lines a track."""
    name = F.concat_ws(" - ", F.coalesce("artist", F.lit("Unknown")), F.coalesce("title", "filename")) if with_titles else c("filename")
    seconds = F.floor(c("duration_ms") / 1000) if with_titles else F.lit(-1)
    each = ordered.select("playlist_id", c("position").cast("long").alias("position"), F.posexplode(F.array(F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), name), c("file_path") if with_titles else c("filename"))).alias("k", "line"))
    rows = each.select("playlist_id", (c("position") * 2 + c("k") + 1).alias("at"), "line")
    head = ordered.select("playlist_id").distinct().select("playlist_id", F.lit(0).cast("long").alias("at"), F.lit("#EXTM3U").alias("line"))
    return rows.unionByName(head)


def write_m3u8(ordered: DataFrame, path: str) -> None:
    """A10: a folder a playlist; all of a playlist's lines in one file, in order."""
    m3u8_lines(ordered).repartition("playlist_id").sortWithinPartitions("playlist_id", "at").select("playlist_id", "line").write.partitionBy("playlist_id").text(path)


def tracklist(ordered: DataFrame) -> DataFrame:
    """The eight columns of the track-list export; confidence as a rounded percent."""
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    percent = F.when(c("key_confidence").isNull(), "").otherwise(F.concat(F.floor(c("key_confidence") * 100 + 0.5).cast("string"), F.lit("%")))
    return ordered.select("playlist_id", (c("position") + 1).alias("#"), blank("title").alias("Title"), blank("artist").alias("Artist"), blank("key_camelot").alias("Key"), F.when(c("bpm").isNull(), "").otherwise(F.format_string("%.1f", "bpm")).alias("BPM"), blank("energy_level").alias("Energy"), blank("duration_ms").alias("Duration"), percent.alias("Confidence"))


def write_tracklist(ordered: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled."""
    tracklist(ordered).repartition("playlist_id").sortWithinPartitions("playlist_id", "#").write.csv(path, header=True, quoteAll=True, escape='"')


def export_manifest(ordered: DataFrame, folder: str, numbered: bool = True) -> DataFrame:
    """Source, destination and tag values of each file of an export, nothing is copied."""
    w = Window.partitionBy("playlist_id").orderBy("position")
    name = F.concat(F.format_string("%03d_", F.row_number().over(w)), c("filename")) if numbered else c("filename")
    return ordered.select("playlist_id", "position", c("file_path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("dest"), c("key_camelot").alias("tag_key"), c("bpm").alias("tag_bpm"))


def tap_tempo(taps: DataFrame, by: str = "session_id", at: str = "ts") -> DataFrame:
    """tempo after each tap from up to three last intervals, 20 to 300, rounded."""
    w = Window.partitionBy(by).orderBy(at)
    second = c(at).cast("timestamp").cast("double")
    gap = taps.withColumn("gap", second - F.lag(second).over(w))
    mean = gap.withColumn("mean", F.avg("gap").over(w.rowsBetween(-2, 0)))
    return mean.select(by, at, F.when(c("mean") > 0, F.floor(F.least(F.lit(300.0), F.greatest(F.lit(20.0), 60.0 / F.when(c("mean") > 0, c("mean")))) + 0.5)).alias("bpm"))
