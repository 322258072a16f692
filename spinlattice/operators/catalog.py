"""The track catalog: filters, pages, lookups and table maintenance.

Maintenance functions take table states and return the new state; the caller writes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

c = F.col
SORTABLE = ["filename", "title", "artist", "bpm", "key_camelot", "energy_level", "duration_ms", "status"]


def library_filter(tracks: DataFrame, search: str | None = None, artist: str | None = None, key: str | None = None, bpm_min: float | None = None, bpm_max: float | None = None, status: str | None = None) -> DataFrame:
    """B1: each condition is optional; search is case-insensitive over file name, title and artist, and its ``%`` and ``_`` are wildcards."""
    if search:
        tracks = tracks.where(reduce(Column.__or__, (F.coalesce(c(x).ilike(f"%{search}%"), F.lit(False)) for x in ("filename", "title", "artist"))))
    for name, value in (("artist", artist), ("key_camelot", key), ("status", status)):
        if value is not None:
            tracks = tracks.where(c(name) == value)
    if bpm_min is not None:
        tracks = tracks.where(c("bpm") >= bpm_min)
    return tracks if bpm_max is None else tracks.where(c("bpm") <= bpm_max)


def preset(tracks: DataFrame, name: str) -> DataFrame:
    """B2."""
    where = {"unanalyzed": c("key_camelot").isNull(), "low_confidence": c("key_confidence") < 0.7, "high_confidence": c("key_confidence") >= 0.85}
    return tracks.where(where[name])


def drawer_search(tracks: DataFrame, search: str) -> DataFrame:
    """Contains, over title, artist, file name and key."""
    q = search.lower()
    return tracks.where(reduce(Column.__or__, (F.lower(F.coalesce(x, F.lit(""))).contains(q) for x in ("title", "artist", "filename", "key_camelot"))))


def lookup(tracks: DataFrame, wanted: DataFrame, column: str, ignore_case: bool = False) -> DataFrame:
    """The first track (least id) for each distinct value in ``wanted``'s column of that name."""
    fold = F.lower if ignore_case else (lambda x: x)
    asked = wanted.select(fold(c(column)).alias("_k")).distinct()
    hit = tracks.withColumn("_k", fold(c(column))).join(asked, "_k")
    w = Window.partitionBy("_k").orderBy("track_id")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_k")


def pending(tracks: DataFrame, limit: int = 1000) -> DataFrame:
    """A page of work, a top-k by id."""
    return tracks.where(c("status").isin("pending", "metadata_ready")).orderBy("track_id").limit(limit)


def needs_repair() -> Column:
    """B6."""
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    return F.coalesce("artist", F.lit("")).isin("", "Unknown Artist") | blank("title") | blank("genre")


def saved_mixes(playlists: DataFrame) -> DataFrame:
    """B9."""
    return playlists.where(F.get_json_object("rules", "$.type") == "mix")


def page(tracks: DataFrame, sort: str = "filename", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """G1: a page of the library; unknown sort columns fall back to the file name, ties go by id."""
    by = c(sort if sort in SORTABLE else "filename")
    return tracks.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_first(), "track_id").offset(offset).limit(limit)


def page_after(tracks: DataFrame, sort: str, value, track_id: int, limit: int = 100) -> DataFrame:
    """G1: the page after a row, without counting through those before it."""
    return tracks.where((c(sort) > value) | ((c(sort) == value) & (c("track_id") > track_id))).orderBy(c(sort).asc_nulls_first(), "track_id").limit(limit)


def scan_report(scanned: DataFrame, tracks: DataFrame) -> DataFrame:
    """A2: total, inserted and updated of a file scan."""
    known = tracks.select("file_path", F.lit(1).alias("known")).distinct()
    return scanned.join(known, "file_path", "left").agg(F.count("*").alias("total"), F.count_if(c("known").isNull()).alias("inserted"), F.count_if(c("known").isNotNull()).alias("updated"))


def ordered_tracks(playlist_tracks: DataFrame, tracks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Playlist rows with their tracks; order by playlist and position when writing or showing.

    With ``tasks`` both sides meet in that many tasks, and a playlist's rows lie together in one of that many, as windows by playlist need them."""
    if tasks is None:
        return playlist_tracks.join(tracks, "track_id")
    return playlist_tracks.repartition(tasks, "track_id").join(tracks.repartition(tasks, "track_id").hint("merge"), "track_id").repartition(tasks, "playlist_id")


def in_mix(tracks: DataFrame, mix: DataFrame, present: bool = True) -> DataFrame:
    """D7."""
    return tracks.join(mix.select("track_id"), "track_id", "left_semi" if present else "left_anti")


def fetch_in_order(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for a request's array ``ids`` with their place; missing ids drop out."""
    return ids.select(F.posexplode("ids").alias("place", "track_id")).join(tracks, "track_id")


def match_imports(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Import rows (row_id, location) with the track they mean: by path, else by path with either slash, else by
    file name in any case. The best rank wins, then the least id; rows without a match keep a null.

    The library is reduced to the least id of each path and each name first, so a name that many tracks share is one row."""
    lib = tracks.select("track_id", "file_path", "filename")
    got, ranks = rows, []
    ways = [(c("location"), c("file_path")), (text.normalize_path(c("location")), text.normalize_path(c("file_path"))), (F.lower(text.basename(c("location"))), F.lower("filename"))]
    for i, (a, b) in enumerate(ways):
        least = lib.groupBy(b.alias(f"_k{i}")).agg(F.min("track_id").alias(f"_t{i}"))
        alone = F.concat(F.lit("\0"), F.xxhash64("row_id"))  # rows without a location meet nothing, and not each other
        got = got.withColumn(f"_k{i}", F.coalesce(a, alone)).join(least, f"_k{i}", "left")
        ranks.append(F.when(c(f"_t{i}").isNotNull(), F.struct(F.lit(i).alias("rank"), c(f"_t{i}").alias("track_id"))))
    return got.withColumn("_m", F.coalesce(*ranks)).select(*rows.columns, c("_m.track_id").alias("track_id"), c("_m.rank").alias("match_rank"))


def import_report(records: DataFrame) -> DataFrame:
    """Total, matched and unmatched records of an import (row, matched, unread), and a message for each that could not be read, by row
    number; such records count as unmatched. The messages are the report, so they are kept whole."""
    bad = F.when(c("unread").isNotNull(), F.struct("row", F.concat(F.lit("Row "), c("row"), F.lit(": parse error: "), c("unread")).alias("text")))
    got = records.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(~c("matched")).alias("unmatched"), F.array_sort(F.collect_list(bad)).alias("bad"))
    return got.select("total", "matched", "unmatched", c("bad.text").alias("errors"))


def upsert(table: DataFrame, updates: DataFrame, by: list[str], newest: str, keep: list[str] | None = None, guard: bool = False) -> DataFrame:
    """H1: new table state. Of several updates of a key the greatest ``newest`` counts; columns in ``keep`` stay as they are on conflict,
    others are replaced. With ``guard`` a row whose ``newest`` is greater than its update's stays whole. One shuffle of both sides on the key."""
    last = updates.groupBy(*by).agg(F.max_by(F.struct(*updates.columns), newest).alias("u")).select("u.*")
    a, b = table.alias("a"), last.alias("b")
    both = a.join(b, [c(f"a.{k}") == c(f"b.{k}") for k in by], "full_outer")
    hit, old = c(f"b.{by[0]}").isNotNull(), c(f"a.{by[0]}").isNotNull()
    if guard:
        hit = hit & F.coalesce(c(f"a.{newest}") <= c(f"b.{newest}"), F.lit(True))
    value = lambda x: F.when(old & hit & F.lit(x in (keep or [])), c(f"a.{x}")).when(hit, c(f"b.{x}")).otherwise(c(f"a.{x}")) if x in updates.columns else c(f"a.{x}")
    return both.select(*(value(x).alias(x) for x in table.columns))


def replace_children(children: DataFrame, parent: str, new: DataFrame) -> DataFrame:
    """H2: the rows of every parent in ``new`` give way to its rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame, nullify: set[str] = frozenset()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """H3: parents without ``gone``; children lose their rows, or the key if named in ``nullify``."""
    ids = gone.select(key).distinct()
    flag = ids.withColumn("_gone", F.lit(True))
    out = {n: d.join(flag, key, "left").withColumn(key, F.when(c("_gone").isNull(), c(key))).drop("_gone").select(*d.columns) if n in nullify else d.join(ids, key, "left_anti") for n, d in children.items()}
    return parents.join(ids, key, "left_anti"), out


def reset_overrides(grids: DataFrame, track_ids: DataFrame) -> DataFrame:
    """H4: override rows of some tracks go."""
    flag = track_ids.select("track_id").distinct()
    return grids.where("not is_override").unionByName(grids.where("is_override").join(flag, "track_id", "left_anti"))


def update_columns(tracks: DataFrame, updates: DataFrame, columns: list[str], replace: bool = False, status: str | None = None) -> DataFrame:
    """Columns of updated tracks: new values, where null the old ones unless ``replace``; updated rows take ``status``."""
    u = updates.select("track_id", *(c(x).alias(f"_{x}") for x in columns), F.lit(True).alias("_hit"))
    both = tracks.join(u, "track_id", "left")
    new = {x: (F.when(c("_hit"), c(f"_{x}")).otherwise(c(x)) if replace else F.coalesce(f"_{x}", x)) for x in columns}
    if status:
        new["status"] = F.when(c("_hit"), F.lit(status)).otherwise(c("status"))
    return both.select(*((new[x] if x in new else c(x)).alias(x) for x in tracks.columns))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows at the end; columns that one side lacks are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def merge_pages(pages: DataFrame, by: str = "track_id", order: str = "page_no") -> DataFrame:
    """H7: the last page's row for each id."""
    return pages.groupBy(by).agg(F.max_by(F.struct(*pages.columns), order).alias("r")).select("r.*")


def load_mix(playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """H9: a mix's tracks in order, with the notes that its rules JSON keeps for a position."""
    notes = playlists.select("playlist_id", F.explode_outer(text.parse_notes(c("rules"))).alias("n")).select("playlist_id", c("n.position").cast("long").alias("position"), "n.notes").where("position is not null")
    return playlist_tracks.join(notes, ["playlist_id", "position"], "left").select("playlist_id", "position", "track_id", "notes")


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """one row for each key, the first in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def progress(tracks: DataFrame, queued: int, elapsed_s: float, finished: int) -> DataFrame:
    """Analysis progress; the rate is that of the queue (``finished`` tracks in ``elapsed_s``), the time to go 0 without a rate."""
    got = tracks.agg(F.count("*").alias("total"), F.count_if(c("status") == "analyzed").alias("completed"))
    rate = finished / elapsed_s if elapsed_s > 0 and finished > 0 else 0.0
    left = c("total") - c("completed")
    return got.select("total", "completed", F.least(left, F.lit(queued)).alias("in_progress"), F.lit(rate).alias("per_second"), (left / F.lit(rate) if rate else F.lit(0.0)).alias("eta_s"))
