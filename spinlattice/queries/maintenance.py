"""Maintenance of stored tables (H1 to H5): a change to part of the keys, then the state that is published."""

from pyspark.sql import functions as F

from ..operators import maintenance
from ..shared import new_path
from ..sources.pages import SortedPages
from ..sources.tables import KeyedTable
from .registry import query

c = F.col


def stored(v, rows, key, files=8):
    """``rows`` as a table of about so many files."""
    return KeyedTable.create(rows, new_path(v.spark, "table"), key, files=files)


@query("h01_stored_upsert", """SELECT track_id, CASE WHEN track_id % 50 < 3 THEN 'X' ELSE key_camelot END AS key_camelot, status FROM v_tracks
UNION ALL SELECT track_id + 10000000, 'X', 'new' FROM v_tracks WHERE track_id % 50 = 0""")  # fmt: skip
def _(v):
    table = stored(v, v("v_tracks").select("track_id", "key_camelot", "status"), "track_id")
    some = v("v_tracks").where("track_id % 50 < 3").select("track_id", F.lit("X").alias("key_camelot"), F.lit("new").alias("status"))
    more = some.where("track_id % 50 = 0").withColumn("track_id", c("track_id") + 10000000)
    maintenance.upsert(table, some.unionByName(more).unionByName(some.withColumn("key_camelot", F.lit("old")).withColumn("status", F.lit("a"))), ["track_id"], "status", ["status"])
    return table.read()


@query("h02_stored_children", """SELECT playlist_id, track_id, position FROM v_playlist_tracks WHERE playlist_id % 30 <> 0
UNION ALL SELECT playlist_id, track_id + 1, position FROM v_playlist_tracks WHERE playlist_id % 30 = 0 AND position < 2""")  # fmt: skip
def _(v):
    table = stored(v, v("v_playlist_tracks"), "playlist_id")
    maintenance.replace_children(table, v("v_playlist_tracks").where("playlist_id % 30 = 0 and position < 2").withColumn("track_id", c("track_id") + 1))
    return table.read().select("playlist_id", "track_id", "position")


@query("h03_stored_cascade", """SELECT 'track' AS kind, track_id, count(*) AS n FROM v_tracks WHERE track_id % 25 <> 0 GROUP BY track_id
UNION ALL SELECT 'opinion', track_id, count(*) FROM v_opinions WHERE track_id % 25 <> 0 GROUP BY track_id
UNION ALL SELECT 'session', CASE WHEN track_id % 25 <> 0 THEN track_id END, count(*) FROM v_gold GROUP BY 2""")  # fmt: skip
def _(v):
    names = {"track": "v_tracks", "opinion": "v_opinions", "session": "v_gold"}
    t = {kind: stored(v, v(name).select("track_id"), "track_id") for kind, name in names.items()}
    maintenance.delete_cascade(t["track"], [t["opinion"]], v("v_tracks").where("track_id % 25 = 0"), [t["session"]])
    counts = [x.read().groupBy(F.lit(kind).alias("kind"), "track_id").agg(F.count("*").alias("n")) for kind, x in t.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("h04_stored_reset", "SELECT track_id, source FROM v_beat_grids WHERE NOT (is_override AND track_id % 20 = 0)")
def _(v):
    table = stored(v, v("v_beat_grids").select("track_id", "source", "is_override"), "track_id")
    maintenance.reset_overrides(table, v("v_tracks").where("track_id % 20 = 0").select("track_id"))
    return table.read().select("track_id", "source")


@query("h05_stored_update", "SELECT track_id, CASE WHEN track_id % 40 = 0 THEN NULL ELSE title END AS title, CASE WHEN track_id % 40 = 0 THEN 'metadata_ready' ELSE status END AS status FROM v_tracks")
def _(v):
    table = stored(v, v("v_tracks").select("track_id", "title", "status"), "track_id")
    some = v("v_tracks").where("track_id % 40 = 0").select("track_id", F.lit(None).cast("string").alias("title"))
    none = some.limit(1).withColumn("track_id", F.lit(-1).cast("long"))
    maintenance.update_columns(table, some.unionByName(none), ["title"], True, "metadata_ready")
    return table.read()


@query("g01_indexed_page", """SELECT track_id, filename, bpm, total FROM (SELECT track_id, filename, bpm, row_number() OVER (ORDER BY bpm DESC NULLS LAST, track_id) AS r, count(*) OVER () AS total
FROM v_tracks WHERE status = 'analyzed') x WHERE r > total // 2 AND r <= total // 2 + 50""")  # fmt: skip
def _(v):
    pages = SortedPages.create(v("v_tracks").select("track_id", "filename", "bpm", "status"), new_path(v.spark, "pages"), "bpm", True, block_rows=500)
    fine = c("status") == "analyzed"
    middle = pages.page(0, 0, fine).total // 2
    page = pages.page(middle, 50, fine)
    return page.rows.select("track_id", "filename", "bpm", F.lit(page.total).cast("long").alias("total"))
