"""Catalog, harmony, consensus, evaluation and set-list queries (A, B, D to H, L)."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import catalog, consensus, evaluation, harmony, sets
from .registry import p6, query, r6
from .scalars import COMPAT, ERR, GENRE, LABEL, MIREX, REL, RISK, SCORE, TOK

c = F.col
N = "NULLS FIRST"
FULL = "SELECT p.playlist_id, p.position, t.* FROM v_playlist_tracks p JOIN v_tracks t ON t.track_id = p.track_id"
ordered = lambda v: catalog.ordered_tracks(v("v_playlist_tracks"), v("v_tracks"))
#: The same for windows by playlist: tasks by the rows of the table that playlists are made of.
gathered = lambda v: catalog.ordered_tracks(v("v_playlist_tracks"), v("v_tracks"), v.tasks("lineitem"))

# B: filters

query("b01_library_filter", "SELECT track_id FROM v_tracks WHERE (lower(coalesce(filename, '')) LIKE '%red%' OR lower(coalesce(title, '')) LIKE '%red%' OR lower(artist) LIKE '%red%' OR filename LIKE '%1%') AND bpm >= 100 AND bpm <= 150 AND status = 'analyzed'")(
    lambda v: catalog.library_filter(v("v_tracks"), bpm_min=100, bpm_max=150, status="analyzed").where(F.coalesce(c("filename").ilike("%red%") | c("title").ilike("%red%") | c("artist").ilike("%red%"), F.lit(False)) | c("filename").contains("1")).select("track_id")
)
query("b01_library_search", "SELECT track_id FROM v_tracks WHERE (lower(filename) LIKE '%brand#1%' OR coalesce(lower(title) LIKE '%brand#1%', false) OR lower(artist) LIKE '%brand#1%') AND key_camelot = '8A'")(lambda v: catalog.library_filter(v("v_tracks"), search="brand#1", key="8A").select("track_id"))
query("b02_presets", "SELECT 'unanalyzed' AS preset, track_id FROM v_tracks WHERE key_camelot IS NULL UNION ALL SELECT 'low_confidence', track_id FROM v_tracks WHERE key_confidence < 0.7 UNION ALL SELECT 'high_confidence', track_id FROM v_tracks WHERE key_confidence >= 0.85")(
    lambda v: (lambda t: catalog.preset(t, "unanalyzed").select(F.lit("unanalyzed").alias("preset"), "track_id").unionByName(catalog.preset(t, "low_confidence").select(F.lit("low_confidence").alias("preset"), "track_id")).unionByName(catalog.preset(t, "high_confidence").select(F.lit("high_confidence").alias("preset"), "track_id")))(v("v_tracks"))
)
query("b03_drawer_search", "SELECT track_id FROM v_tracks WHERE strpos(lower(coalesce(title, '')), '12') > 0 OR strpos(lower(coalesce(artist, '')), '12') > 0 OR strpos(lower(filename), '12') > 0 OR strpos(lower(coalesce(key_camelot, '')), '12') > 0")(lambda v: catalog.drawer_search(v("v_tracks"), "12").select("track_id"))
query("b04_lookup", "SELECT min(t.track_id) AS track_id, lower(t.artist) AS artist FROM v_tracks t WHERE lower(t.artist) IN (SELECT lower(artist) FROM v_setlist_all) GROUP BY lower(t.artist)")(lambda v: catalog.lookup(v("v_tracks"), v("v_setlist_all"), "artist", ignore_case=True).select("track_id", F.lower("artist").alias("artist")))
query("b05_pending", f"SELECT track_id, status FROM v_tracks WHERE status IN ('pending', 'metadata_ready') ORDER BY track_id {N} LIMIT 100")(lambda v: catalog.pending(v("v_tracks"), 100).select("track_id", "status"))
query("b06_needs_repair", "SELECT t.track_id FROM v_tracks t JOIN v_genres g ON g.track_id = t.track_id WHERE coalesce(t.artist, '') IN ('', 'Unknown Artist') OR coalesce(t.title, '') = '' OR coalesce(g.genre_raw, '') = ''")(lambda v: v("v_tracks").join(v("v_genres").select("track_id", c("genre_raw").alias("genre")), "track_id").where(catalog.needs_repair()).select("track_id"))
LISTING = "SELECT location, CASE WHEN track_id % 7 = 3 THEN 'ape' WHEN track_id % 7 = 5 THEN '3gp' ELSE extension END AS extension, CASE WHEN track_id % 10 = 9 THEN NULL WHEN track_id % 10 = 8 THEN 200000000 ELSE 5000000 END AS length, CASE WHEN track_id % 29 = 0 THEN 'All' ELSE truth_camelot END AS key FROM v_predictions"
STATUS = f"SELECT location, CASE WHEN length IS NULL THEN 'missing_file' WHEN length > 157286400 THEN 'large_mix' WHEN extension NOT IN ('mp3', 'wav', 'flac', 'ogg', 'oga', 'opus', 'aiff', 'aif', 'm4a', 'aac', 'wma', 'alac', 'mkv', 'mp4', 'mov', 'webm', 'm4v', 'avi', 'flv', 'mpg', 'mpeg', 'ts', '3gp') THEN 'unsupported' WHEN coalesce(key, '') = '' THEN 'no_key_label' WHEN key = 'All' THEN 'atonal' ELSE 'ready' END AS status FROM ({LISTING}) x"


def corpus(v):
    p = v("v_predictions")
    kind = F.when(c("track_id") % 7 == 3, "ape").when(c("track_id") % 7 == 5, "3gp").otherwise(c("extension"))
    rows = p.select("location", kind.alias("extension"), "track_id", F.when(c("track_id") % 29 == 0, "All").otherwise(c("truth_camelot")).alias("key"))
    files = p.where("track_id % 10 <> 9").select(c("location").alias("path"), F.when(c("track_id") % 10 == 8, 200000000).otherwise(5000000).alias("length"))
    return evaluation.classify(rows, files)


query("b07_corpus_status", STATUS)(lambda v: corpus(v).select("location", "status"))
#: The searches' stated query set: every row whose id is divisible by 50, against all rows.
SEEDS = "SELECT track_id AS seed_id, key_camelot AS seed_key, bpm AS seed_bpm FROM v_tracks WHERE track_id % 50 = 0"
seeds = lambda v: v("v_tracks").where("track_id % 50 = 0")
EVERY = lambda sql: sql.replace(" WHERE track_id % 50 = 0", "")
MOVES = "(bn.n - an.n + 12) % 12"
SEEDED = f"SELECT x.*, {COMPAT} AS compat FROM (SELECT s.*, t.track_id, t.key_camelot, t.bpm, (bn.n - an.n + 12) % 12 AS d, an.c = bn.c AS same, an.c AS ac FROM ({SEEDS}) s JOIN v_tracks t ON t.track_id <> s.seed_id LEFT JOIN v_dim an ON an.code = s.seed_key LEFT JOIN v_dim bn ON bn.code = t.key_camelot) x"
COMPATIBLE = f"SELECT seed_id, track_id, key_camelot, CAST(compat AS DOUBLE) AS score FROM ({SEEDED}) y WHERE compat > 0"
compatible = lambda v, s: harmony.compatible_tracks(v("v_tracks"), s(v))
query("b08_compatible_tracks", COMPATIBLE)(lambda v: compatible(v, seeds))
PLAYLISTS = "SELECT DISTINCT playlist_id, CASE WHEN playlist_id % 3 = 0 THEN '{\"type\":\"mix\"}' WHEN playlist_id % 3 = 1 THEN 'broken {' END AS rules FROM v_playlist_tracks"


def playlists(v):
    return v("v_playlist_tracks").select("playlist_id").distinct().withColumn("rules", F.when(c("playlist_id") % 3 == 0, '{"type":"mix"}').when(c("playlist_id") % 3 == 1, "broken {"))


query("b09_saved_mixes", f"SELECT playlist_id FROM ({PLAYLISTS}) x WHERE playlist_id % 3 = 0")(lambda v: catalog.saved_mixes(playlists(v)).select("playlist_id"))

# Reports and export tables

query("a02_scan_report", "SELECT count(*) AS total, count(*) FILTER (WHERE track_id % 4 <> 0) AS inserted, count(*) FILTER (WHERE track_id % 4 = 0) AS updated FROM v_tracks")(lambda v: catalog.scan_report(v("v_tracks").select("file_path"), v("v_tracks").where("track_id % 4 = 0")))
query("a10_m3u8", f"SELECT playlist_id, position * 2 + 1 AS at, concat('#EXTINF:', CAST(CAST(floor(duration_ms / 1000.0) AS BIGINT) AS STRING), ',', artist, ' - ', coalesce(title, filename)) AS line FROM ({FULL}) x UNION ALL SELECT playlist_id, position * 2 + 2, file_path FROM ({FULL}) y UNION ALL SELECT DISTINCT playlist_id, 0, '#EXTM3U' FROM v_playlist_tracks")(lambda v: sets.m3u8_lines(ordered(v)))
query("a11_tracklist", f"SELECT playlist_id, position + 1 AS n, coalesce(title, '') AS title, artist, coalesce(key_camelot, '') AS key, CASE WHEN bpm IS NULL THEN '' ELSE printf('%.1f', bpm) END AS bpm, concat(CAST(CAST(floor(key_confidence * 100 + 0.5) AS INT) AS STRING), '%') AS confidence FROM ({FULL}) x")(lambda v: sets.tracklist(ordered(v)).select("playlist_id", c("#").alias("n"), c("Title").alias("title"), c("Artist").alias("artist"), c("Key").alias("key"), c("BPM").alias("bpm"), c("Confidence").alias("confidence")))
query("a12_export_manifest", f"SELECT playlist_id, position, file_path AS src, concat('/out/', lpad(CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY position) AS STRING), 3, '0'), '_', filename) AS dest, key_camelot AS tag_key, bpm AS tag_bpm FROM ({FULL}) x")(lambda v: sets.export_manifest(gathered(v), "/out"))
SAMPLE = f"SELECT *, row_number() OVER (PARTITION BY genre ORDER BY md5(concat('42', location)), location) AS pick FROM (SELECT location, {GENRE} AS genre FROM (SELECT location, lower(trim(coalesce(genre_raw, ''))) AS g FROM v_predictions) a) b"
genred = lambda v: v("v_predictions").select("location", text.normalize_genre(c("genre_raw")).alias("genre"))
query("f06_stratified_sample", f"SELECT location, genre, pick FROM ({SAMPLE}) x ORDER BY pick, genre LIMIT 500")(lambda v: evaluation.stratified_sample(genred(v), 42, 500))
query("a13_sample_manifest", f"SELECT 42 AS seed, 500 AS row_limit, count(*) AS n, md5(string_agg(location, ',' ORDER BY location)) AS tracks FROM (SELECT * FROM ({SAMPLE}) x ORDER BY pick, genre LIMIT 500) y")(
    lambda v: evaluation.stratified_sample(genred(v), 42, 500).agg(F.lit(42).alias("seed"), F.lit(500).alias("row_limit"), F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("location")), ",")).alias("tracks"))
)

# D: joins

query("d01_playlist_tracks", f"SELECT playlist_id, position, track_id, title, key_camelot, bpm FROM ({FULL}) x")(lambda v: ordered(v).select("playlist_id", "position", "track_id", "title", "key_camelot", "bpm"))
IMPORTS = "SELECT track_id AS row_id, CASE WHEN track_id % 4 = 0 THEN file_path WHEN track_id % 4 = 1 THEN replace(file_path, '/', chr(92)) WHEN track_id % 4 = 2 THEN concat('D:/other/', upper(filename)) ELSE 'D:/none.mp3' END AS location FROM v_tracks"


def imports(v):
    way = F.when(c("track_id") % 4 == 0, c("file_path")).when(c("track_id") % 4 == 1, text.normalize_path(c("file_path"))).when(c("track_id") % 4 == 2, F.concat(F.lit("D:/other/"), F.upper("filename"))).otherwise("D:/none.mp3")
    return v("v_tracks").select(c("track_id").alias("row_id"), way.alias("location"))


def import_counts(v):
    matched = catalog.match_imports(imports(v), v("v_tracks"))
    report = catalog.import_report(matched.select(c("row_id").alias("row"), c("track_id").isNotNull().alias("matched"), F.lit(None).cast("string").alias("unread")))
    return report.select("total", "matched", "unmatched", F.size("errors").alias("n_errors"))


query("d02_import_match", "SELECT track_id AS row_id, CASE WHEN track_id % 4 < 3 THEN track_id END AS track_id, CASE WHEN track_id % 4 < 3 THEN CAST(track_id % 4 AS INT) END AS match_rank FROM v_tracks")(lambda v: catalog.match_imports(imports(v), v("v_tracks")).select("row_id", "track_id", "match_rank"))
query("e18_import_report", "SELECT count(*) AS total, count(*) FILTER (WHERE track_id % 4 < 3) AS matched, count(*) FILTER (WHERE track_id % 4 = 3) AS unmatched, CAST(0 AS INT) AS n_errors FROM v_tracks")(lambda v: import_counts(v))
SEED_SCORES = f"SELECT seed_id, track_id, CAST(compat AS DOUBLE) AS compat, round(compat * 0.7 + (1 - least(abs(coalesce(bpm, coalesce(seed_bpm, 128)) - coalesce(seed_bpm, 128)), 20) / 20) * 0.3, 6) AS total FROM ({SEEDED}) y"
seed_scores = lambda v, s: harmony.score_seed(v("v_tracks"), s(v)).select("seed_id", "track_id", "compat", p6(c("total")).alias("total"))
query("d04_seed_scores", SEED_SCORES)(lambda v: seed_scores(v, seeds))
PAIRS = "SELECT x.*, CASE WHEN d = 0 AND same THEN 'same-key' WHEN d = 0 THEN 'mood-shift' WHEN d IN (1, 11) THEN 'neighbor' WHEN d = 2 THEN 'energy-boost' ELSE 'energy-drop' END AS relation FROM (SELECT a.track_id, b.track_id AS other_id, (b.bpm - a.bpm) / a.bpm * 100 AS delta, (b.n - a.n + 12) % 12 AS d, a.c = b.c AS same FROM v_keys a JOIN v_keys b ON a.track_id <> b.track_id AND abs(b.bpm - a.bpm) / a.bpm <= 0.06 AND ((a.c = b.c AND (b.n - a.n + 12) % 12 IN (0, 1, 2, 10, 11)) OR (a.c <> b.c AND a.n = b.n))) x"
near = lambda v: harmony.neighbours(v("v_tracks"))
BASES = "CASE relation WHEN 'same-key' THEN 95 WHEN 'neighbor' THEN 85 WHEN 'mood-shift' THEN 80 WHEN 'energy-boost' THEN 75 ELSE 70 END"
query("d05_neighbours", f"SELECT track_id, other_id, relation, round(delta, 6) AS delta_pct, {BASES} AS score FROM ({PAIRS}) p")(lambda v: near(v).select("track_id", "other_id", "relation", p6(c("delta_pct")).alias("delta_pct"), "score"))
POSITIONED = """SELECT track_id, other_id, gap, CASE WHEN d = 0 AND same THEN 'same' WHEN d = 0 THEN 'mood_shift' WHEN d = 1 THEN 'plus_one' WHEN d = 11 THEN 'minus_one' WHEN d = 2 THEN 'plus_two' ELSE 'minus_two' END AS relation
FROM (SELECT a.track_id, b.track_id AS other_id, abs(b.bpm - a.bpm) AS gap, (b.n - a.n + 12) % 12 AS d, a.c = b.c AS same
 FROM v_keys a JOIN v_keys b ON a.track_id <> b.track_id AND ((a.c = b.c AND (b.n - a.n + 12) % 12 IN (0, 1, 2, 10, 11)) OR (a.c <> b.c AND a.n = b.n))) x"""
TOPN = f"SELECT *, row_number() OVER (PARTITION BY track_id, relation ORDER BY gap NULLS LAST, other_id) AS rnk FROM ({POSITIONED}) p"


@query("f05_top_per_relation", f"SELECT track_id, other_id, relation, round(gap, 6) AS gap, rnk FROM ({TOPN}) z WHERE rnk <= 8")
def _(v):
    return harmony.top_per_relation(v("v_tracks")).select("track_id", "other_id", "relation", r6(c("gap")).alias("gap"), c("rank").alias("rnk"))


#: What counts as already in the mix: the pairs that open a playlist.
USED = "SELECT DISTINCT a_id AS track_id, b_id AS other_id FROM v_pairs WHERE position = 0"
CANDIDATES = f"""SELECT x.track_id, x.other_id, relation, CAST(greatest(0, least(100, CASE relation WHEN 'same-key' THEN 95 WHEN 'neighbor' THEN 85 WHEN 'mood-shift' THEN 80 WHEN 'energy-boost' THEN 75 WHEN 'energy-drop' THEN 70 WHEN 'tension' THEN 40 ELSE 20 END
 - CASE WHEN abs(delta) > 6 THEN least(20, floor((abs(delta) - 6) * 2 + 0.5)) ELSE 0 END)) AS INT) AS score, delta, u.other_id IS NOT NULL AS used
FROM (SELECT y.*, CASE WHEN d = 0 AND same THEN 'same-key' WHEN d = 0 THEN 'mood-shift' WHEN NOT same THEN 'bridge-needed' WHEN d IN (1, 11) THEN 'neighbor' WHEN d = 2 THEN 'energy-boost' WHEN d = 10 THEN 'energy-drop' ELSE 'tension' END AS relation
 FROM (SELECT a.track_id, b.track_id AS other_id, CASE WHEN a.bpm > 0 AND b.bpm IS NOT NULL THEN (b.bpm - a.bpm) / a.bpm * 100 ELSE 0 END AS delta, (b.n - a.n + 12) % 12 AS d, a.c = b.c AS same FROM v_keys a JOIN v_keys b ON a.track_id <> b.track_id) y) x
LEFT JOIN ({USED}) u ON u.track_id = x.track_id AND u.other_id = x.other_id"""
WHY = "CASE relation WHEN 'same-key' THEN 'Same key — seamless blend' WHEN 'neighbor' THEN 'Smooth harmonic step' WHEN 'mood-shift' THEN 'Major/minor mood change' WHEN 'energy-boost' THEN 'Classic energy lift' WHEN 'energy-drop' THEN 'Cooldown move' WHEN 'tension' THEN 'Creative risk' ELSE 'Far apart — use with care' END"


@query("g03_next_candidates", f"SELECT track_id, other_id, relation, score, used, concat({WHY}, CASE WHEN used THEN '. Already in mix' ELSE '' END) AS reason, rnk FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, used, abs(delta), other_id) AS rnk FROM ({CANDIDATES}) p) z WHERE rnk <= 20")
def _(v):
    # the pairs of v_pairs with position 0, from the view's own grouping by playlist; tracks that the library lacks count for nothing below
    at = lambda p: F.max(F.when(c("position") == p, c("track_id")))
    opened = v("v_playlist_tracks").where("position < 2").groupBy("playlist_id").agg(at(0).alias("track_id"), at(1).alias("other_id")).where("other_id is not null")
    return harmony.next_candidates(v("v_tracks"), opened).select("track_id", "other_id", "relation", "score", "used", "reason", c("rank").alias("rnk"))


SIM = lambda a, b: f"(CASE WHEN len(list_concat({a}, {b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"
query("d06_fuzzy_setlist", f"""SELECT set_id, position, track_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY set_id, position ORDER BY s DESC, filename, track_id) AS rn FROM (
SELECT set_id, position, track_id, filename, 0.6 * greatest({SIM('lt', 'tt')}, {SIM('lt', 'tf')}) + 0.4 * {SIM('la', 'ta')} AS s FROM (SELECT set_id, position, {TOK('title')} AS lt, {TOK('artist')} AS la FROM v_setlist WHERE set_id % 250 = 0) l
CROSS JOIN (SELECT track_id, filename, CASE WHEN title IS NULL THEN [] ELSE {TOK('title')} END AS tt, {TOK('artist')} AS ta, {TOK('filename')} AS tf FROM v_tracks) t) x WHERE s > 0.5) y WHERE rn = 1""".replace("WHERE set_id % 250 = 0", ""))(
    lambda v: sets.match_setlist(v("v_setlist"), v("v_tracks"), ["set_id", "position"]).select("set_id", "position", "track_id", r6(c("similarity")).alias("similarity"))
)
query("d07_in_mix", "SELECT track_id, track_id IN (SELECT track_id FROM v_setlist_tracks) AS used FROM v_tracks".replace("v_setlist_tracks", "v_playlist_tracks WHERE playlist_id % 50 = 0"))(
    lambda v: (lambda t, m: catalog.in_mix(t, m).select("track_id", F.lit(True).alias("used")).unionByName(catalog.in_mix(t, m, False).select("track_id", F.lit(False).alias("used"))))(v("v_tracks"), v("v_playlist_tracks").where("playlist_id % 50 = 0"))
)
WHEEL = "SELECT d.code, d.n AS num, d.c, coalesce(k.n, 0) AS n FROM v_dim d LEFT JOIN (SELECT key_camelot AS code, count(*) AS n FROM v_tracks WHERE key_camelot IS NOT NULL GROUP BY key_camelot) k ON k.code = d.code"
query("d08_dense_wheel", f"SELECT code, n, CASE WHEN code = '8A' THEN 'same' WHEN num = 8 THEN 'mood_shift' WHEN c = 'B' THEN 'incompatible' WHEN num = 9 THEN 'plus_one' WHEN num = 7 THEN 'minus_one' WHEN num = 10 THEN 'plus_two' WHEN num = 6 THEN 'minus_two' ELSE 'incompatible' END AS relation FROM ({WHEEL}) w")(lambda v: harmony.wheel_counts(v("v_tracks"), "8A").select("code", "n", "relation"))
query("e14_wheel_histogram", f"SELECT code, n, max(n) OVER () AS max_n FROM ({WHEEL}) w")(lambda v: harmony.wheel_counts(v("v_tracks")).select("code", "n", "max_n"))
MODAL = "SELECT track_id, key_camelot, n, best, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, best DESC, key_camelot) AS rn FROM (SELECT track_id, key_camelot, count(*) AS n, max(confidence) AS best FROM v_opinions WHERE key_camelot IS NOT NULL GROUP BY track_id, key_camelot) k"
CONS = f"""SELECT o.track_id, o.source_count, m.key_camelot, coalesce(m.n, 0) AS agreeing, round(o.bpm, 6) AS bpm, len(list_filter(o.l, lambda x: abs(x - o.bpm) <= 1)) AS bpm_agreeing,
CASE WHEN o.keyed <= 1 THEN 'single' WHEN o.dk = 1 THEN 'agreed' ELSE 'contested' END AS status FROM (SELECT *, list_sort(l)[len(l) // 2 + 1] AS bpm FROM (SELECT track_id, count(*) AS source_count, count(key_camelot) AS keyed, count(DISTINCT key_camelot) AS dk, coalesce(list(bpm) FILTER (WHERE bpm IS NOT NULL), []) AS l FROM v_opinions GROUP BY track_id) a) o
LEFT JOIN ({MODAL}) m ON m.track_id = o.track_id AND m.rn = 1"""
CCOLS = lambda: ["track_id", "source_count", "key_camelot", "agreeing", r6(c("bpm")).alias("bpm"), "bpm_agreeing", "status"]
query("e01_consensus", CONS)(lambda v: consensus.consensus(v("v_opinions")).select(*CCOLS()))
query("d09_consensus_batch", f"SELECT t.track_id, coalesce(x.source_count, 0) AS source_count, x.key_camelot, coalesce(x.status, 'unknown') AS status FROM v_tracks t LEFT JOIN ({CONS}) x ON x.track_id = t.track_id")(lambda v: consensus.consensus_for(v("v_tracks"), v("v_opinions")).select("track_id", "source_count", "key_camelot", "status"))
query("d10_apply_proposals", "SELECT track_id, CASE WHEN track_id % 3 = 0 AND track_id % 2 = 0 THEN concat('new ', CAST(track_id AS STRING)) ELSE title END AS title, CASE WHEN track_id % 3 = 0 THEN 'fixed' ELSE artist END AS artist FROM v_tracks")(
    lambda v: catalog.update_columns(v("v_tracks"), v("v_tracks").where("track_id % 3 = 0").select("track_id", F.when(c("track_id") % 2 == 0, F.concat(F.lit("new "), "track_id")).alias("title"), F.lit("fixed").alias("artist")), ["title", "artist"]).select("track_id", "title", "artist")
)
query("d11_ordered_fetch", "SELECT p.playlist_id, CAST(p.position AS INT) AS place, p.track_id, t.title FROM v_playlist_tracks p JOIN v_tracks t ON t.track_id = p.track_id")(
    lambda v: v("v_playlist_tracks").groupBy("playlist_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "track_id"))), lambda r: r["track_id"]).alias("ids")).select("playlist_id", F.posexplode("ids").alias("place", "track_id")).join(v("v_tracks").select("track_id", "title"), "track_id")
)

# E: aggregations

query("e02_contested", "SELECT track_id, count(DISTINCT key_camelot) AS n_keys FROM v_opinions GROUP BY track_id HAVING count(DISTINCT key_camelot) > 1 ORDER BY n_keys DESC, track_id LIMIT 100")(lambda v: consensus.contested(v("v_opinions")))
query("e03_gold_summary", "SELECT count(*) AS annotations, count(DISTINCT track_id) AS tracks, (SELECT count(*) FROM v_tracks) AS total_tracks FROM v_gold")(lambda v: consensus.gold_summary(v("v_gold"), v("v_tracks")))
query("e04_self_agreement", "SELECT count(*) AS tracks, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT track_id, count(DISTINCT concat(CAST(tonic_pc AS STRING), '|', key_mode)) AS k FROM v_gold WHERE annotator_id = 'self' GROUP BY track_id HAVING count(*) >= 2) x")(lambda v: consensus.self_agreement(v("v_gold")).select("tracks", r6(c("agreement")).alias("agreement")))
query("e05_mode_distribution", "SELECT key_mode, count(*) AS n FROM v_gold GROUP BY key_mode")(lambda v: consensus.mode_distribution(v("v_gold")))
query("e06_training_stats", "SELECT session_type, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) * 100.0 / count(*), 6) AS percent FROM v_training GROUP BY ROLLUP (session_type)")(lambda v: consensus.training_stats(v("v_training")).withColumn("percent", r6(c("percent"))))
#: A queue that has finished 90 tracks in two minutes and holds 50 more.
query("e07_progress", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'analyzed') AS completed, least(count(*) FILTER (WHERE status <> 'analyzed'), 50) AS in_progress, CAST(0.75 AS DOUBLE) AS per_second, round(count(*) FILTER (WHERE status <> 'analyzed') / CAST(0.75 AS DOUBLE), 6) AS eta_s FROM v_tracks")(
    lambda v: catalog.progress(v("v_tracks"), 50, 120.0, 90).withColumn("eta_s", r6(c("eta_s")))
)
OK = f"SELECT s.*, {GENRE} AS genre, CASE WHEN tt IS NOT NULL AND pt IS NOT NULL THEN {MIREX} END AS mirex, CASE WHEN tt IS NOT NULL AND pt IS NOT NULL THEN {ERR} END AS error FROM (SELECT x.*, lower(trim(coalesce(genre_raw, ''))) AS g, CAST(pred_bpm AS DOUBLE) AS pb, CAST(truth_bpm AS DOUBLE) AS tb FROM v_scored x) s"
_pct = lambda x: f"round(count(*) FILTER (WHERE {x}) * 100.0 / count(*), 6)"
_tpct = lambda x: f"round(count(*) FILTER (WHERE {x}) * 100.0 / nullif(count(*) FILTER (WHERE pb IS NOT NULL AND tb IS NOT NULL), 0), 6)"
query("e08_accuracy_partitions", f"SELECT genre, extension, CAST(grouping(genre, extension) AS BIGINT) AS gid, count(*) AS n, {_pct("error = 'correct'")} AS exact_pct, {_pct('pt = tt')} AS tonic_pct, round(sum(coalesce(mirex, 0)) / count(*), 6) AS mirex, {_pct('mirex > 0')} AS compatible_pct, {_tpct('abs(pb - tb) <= 1')} AS bpm_exact_pct, {_tpct('abs(pb - tb) <= 1 OR abs(pb * 0.5 - tb) <= 1 OR abs(pb * 2 - tb) <= 1')} AS bpm_octave_pct FROM ({OK}) o WHERE failure IS NULL GROUP BY GROUPING SETS ((), (genre), (extension))")(
    lambda v: (lambda d: d.select("genre", "extension", c("gid").cast("long").alias("gid"), "n", *(r6(c(x)).alias(x) for x in ("exact_pct", "tonic_pct", "mirex", "compatible_pct", "bpm_exact_pct", "bpm_octave_pct"))))(evaluation.partitions(evaluation.score(v("v_predictions"))))
)
query("e09_error_map", f"SELECT genre, error, count(*) AS n FROM ({OK}) o WHERE failure IS NULL AND error IS NOT NULL GROUP BY genre, error")(lambda v: evaluation.error_map(evaluation.score(v("v_predictions"))).select("genre", F.explode("errors").alias("error", "n")))
LAB = "SELECT tt + CASE WHEN tm THEN 0 ELSE 12 END AS label, pt + CASE WHEN pm THEN 0 ELSE 12 END AS pred_label FROM v_scored WHERE tt IS NOT NULL AND pt IS NOT NULL"
query("e10_confusion", f"SELECT label, pred_label, count(*) AS n FROM ({LAB}) x GROUP BY label, pred_label")(lambda v: evaluation.confusion(evaluation.score(v("v_predictions"))))
query("e10_class_report", f"SELECT label, support, round(coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(support + predicted, 0), 0), 6) AS f1 FROM (SELECT l.label, (SELECT count(*) FROM ({LAB}) x WHERE x.label = l.label) AS support, (SELECT count(*) FROM ({LAB}) x WHERE x.pred_label = l.label) AS predicted, (SELECT count(*) FROM ({LAB}) x WHERE x.label = l.label AND x.pred_label = l.label) AS tp FROM (SELECT label FROM ({LAB}) a UNION SELECT pred_label FROM ({LAB}) b) l) z")(
    lambda v: evaluation.class_report(evaluation.score(v("v_predictions"))).select("label", "support", r6(c("precision")).alias("precision"), r6(c("recall")).alias("recall"), r6(c("f1")).alias("f1"))
)
query("e11_evaluation_summary", f"SELECT count(*) AS n, round(avg(CASE WHEN error = 'correct' THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN error = 'fifth' AND (pt - tt + 12) % 12 = 5 THEN 0 ELSE mirex END), 6) AS mirex, round(avg(CASE WHEN error = 'relative' THEN 1.0 ELSE 0.0 END), 6) AS relative, round(avg(CASE WHEN error = 'parallel' THEN 1.0 ELSE 0.0 END), 6) AS parallel FROM ({OK}) o WHERE error IS NOT NULL")(
    lambda v: (lambda d: d.select("n", *(r6(c(x)).alias(x) for x in ("accuracy", "mirex", "relative", "parallel"))))(evaluation.summary(evaluation.score(v("v_predictions"))))
)
query("e12_run_summary", "SELECT round(list_sort(l)[len(l) // 2 + 1], 6) AS ratio_median, round(mean_ms, 6) AS mean_ms, failed FROM (SELECT list(CASE WHEN truth_bpm > 0 THEN CAST(pred_bpm AS DOUBLE) / CAST(truth_bpm AS DOUBLE) ELSE 1.0 END) FILTER (WHERE failure IS NULL AND pred_bpm IS NOT NULL AND truth_bpm IS NOT NULL) AS l, avg(total_ms) FILTER (WHERE failure IS NULL) AS mean_ms, count(*) FILTER (WHERE failure IS NOT NULL) AS failed FROM v_predictions) x")(
    lambda v: evaluation.run_summary(evaluation.score(v("v_predictions"))).select(r6(c("ratio_median")).alias("ratio_median"), r6(c("mean_ms")).alias("mean_ms"), "failed")
)
SHARES = f"""count(*) AS n, {_pct("error = 'correct'")} AS exact_pct, {_pct('pt = tt')} AS tonic_pct, round(sum(coalesce(mirex, 0)) / count(*), 6) AS mirex, {_pct('mirex > 0')} AS compatible_pct,
{_tpct('abs(pb - tb) <= 1')} AS bpm_exact_pct, {_tpct('abs(pb - tb) <= 1 OR abs(pb * 0.5 - tb) <= 1 OR abs(pb * 2 - tb) <= 1')} AS bpm_octave_pct"""
REPORTED = f"""SELECT 'overall' AS kind, NULL AS name, {SHARES} FROM ({OK}) o WHERE failure IS NULL
UNION ALL SELECT 'genre', genre, {SHARES} FROM ({OK}) o WHERE failure IS NULL GROUP BY genre
UNION ALL SELECT 'extension', extension, {SHARES} FROM ({OK}) o WHERE failure IS NULL GROUP BY extension
UNION ALL SELECT 'error', error, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM ({OK}) o WHERE failure IS NULL AND error IS NOT NULL GROUP BY error"""


@query("a14_accuracy_report", REPORTED)
def _(v):
    shares = ["exact_pct", "tonic_pct", "mirex", "compatible_pct", "bpm_exact_pct", "bpm_octave_pct"]
    part = "struct<name:string,n:bigint," + ",".join(f"{x}:double" for x in shares) + ">"
    js = evaluation.report(evaluation.score(v("v_predictions"))).select(F.from_json("report", f"overall {part}, by_genre array<{part}>, by_extension array<{part}>, errors map<string,bigint>").alias("r"))
    rows = lambda kind, x: js.select(F.lit(kind).alias("kind"), F.inline(x))
    wrong = js.select(F.lit("error").alias("kind"), F.explode("r.errors").alias("name", "n"), *(F.lit(None).cast("double").alias(x) for x in shares))
    got = rows("overall", F.array("r.overall")).unionByName(rows("genre", c("r.by_genre"))).unionByName(rows("extension", c("r.by_extension"))).unionByName(wrong)
    return got.withColumns({x: r6(c(x)) for x in shares})


query("e13_status_counts", f"SELECT status, count(*) AS n FROM ({STATUS}) x GROUP BY status")(lambda v: evaluation.status_counts(corpus(v)))
LINES = "SELECT s.set_id, s.position, s.position % 5 <> 4 AS matched, CASE WHEN s.position % 5 <> 4 THEN t.key_camelot END AS key_camelot, CASE WHEN s.position % 5 <> 4 THEN t.bpm END AS bpm, CASE WHEN s.position % 5 <> 4 THEN t.energy_level END AS energy_level FROM v_setlist s JOIN v_playlist_tracks p ON p.playlist_id = s.set_id AND p.position = s.position JOIN v_tracks t ON t.track_id = p.track_id"


ALL = lambda sql: re.sub(r"\bv_setlist\b", "v_setlist_all", sql)


def lines(v):
    hit = c("position") % 5 != 4
    return gathered(v).select(c("playlist_id").alias("set_id"), "position", hit.alias("matched"), *(F.when(hit, c(x)).alias(x) for x in ("key_camelot", "bpm", "energy_level")))


SET_SUMMARY = f"SELECT set_id, count(*) AS total, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS unmatched, coalesce(string_agg(key_camelot, '>' ORDER BY position), '') AS key_flow, min(bpm) AS bpm_min, max(bpm) AS bpm_max, coalesce(string_agg(CAST(energy_level AS STRING), '>' ORDER BY position), '') AS energy_arc FROM ({LINES}) x GROUP BY set_id"


def summary(v):
    got = sets.set_summary(lines(v))
    return got.withColumn("key_flow", F.array_join("key_flow", ">")).withColumn("energy_arc", F.array_join(F.transform("energy_arc", lambda x: x.cast("string")), ">"))


query("e15_setlist_summary", ALL(SET_SUMMARY))(summary)
query("e16_label_distribution", "SELECT tt + CASE WHEN tm THEN 0 ELSE 12 END AS label, count(*) AS n FROM v_scored WHERE tt IS NOT NULL GROUP BY 1")(lambda v: evaluation.label_distribution(evaluation.score(v("v_predictions"))))
query("e17_filtered_count", "SELECT count(*) AS n FROM v_tracks WHERE bpm >= 100 AND bpm <= 120")(lambda v: catalog.library_filter(v("v_tracks"), bpm_min=100, bpm_max=120).agg(F.count("*").alias("n")))
query("e19_by_source", "SELECT track_id, engine, tagcsv, djxml, fingerprint, n = 1 AS agree FROM (SELECT track_id, max(key_camelot) FILTER (WHERE source = 'engine') AS engine, max(key_camelot) FILTER (WHERE source = 'tagcsv') AS tagcsv, max(key_camelot) FILTER (WHERE source = 'djxml') AS djxml, max(key_camelot) FILTER (WHERE source = 'fingerprint') AS fingerprint, count(DISTINCT key_camelot) AS n FROM v_opinions GROUP BY track_id) x")(lambda v: consensus.by_source(v("v_opinions")))
RELATION_COUNTS = f"SELECT seed_id, {REL} AS relation, count(*) AS n FROM (SELECT s.seed_id, (bn.n - an.n + 12) % 12 AS d, an.c = bn.c AS same FROM ({SEEDS}) s JOIN v_tracks t ON t.track_id <> s.seed_id LEFT JOIN v_dim an ON an.code = s.seed_key LEFT JOIN v_dim bn ON bn.code = t.key_camelot) x GROUP BY 1, 2"
relation_counts = lambda v, s: harmony.bucket_counts(v("v_tracks"), s(v))
query("e20_relation_counts", EVERY(RELATION_COUNTS))(lambda v: relation_counts(v, lambda v: v("v_tracks")))
query("l01_validation", "SELECT count(*) AS n, count(*) FILTER (WHERE a.key_camelot = b.key_camelot) AS agree, round(avg(CASE WHEN a.key_camelot = b.key_camelot THEN 100.0 ELSE 0.0 END), 6) AS percent FROM v_opinions a JOIN v_opinions b ON a.track_id = b.track_id AND a.source = 'engine' AND b.source = 'tagcsv' WHERE a.key_camelot IS NOT NULL AND b.key_camelot IS NOT NULL")(lambda v: consensus.validation(v("v_opinions")).withColumn("percent", r6(c("percent"))))
query("l02_recalibration", "SELECT o.source, count(*) AS n, round(avg(CASE WHEN o.key_camelot = t.key_camelot THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(pow(avg(CASE WHEN o.key_camelot = t.key_camelot THEN 1.0 ELSE 0.0 END), 2), 6) AS weight FROM v_opinions o JOIN v_tracks t ON t.track_id = o.track_id WHERE o.key_camelot IS NOT NULL AND t.key_camelot IS NOT NULL GROUP BY o.source")(
    lambda v: consensus.recalibrate(v("v_opinions"), v("v_tracks").select("track_id", c("key_camelot").alias("truth"))).withColumn("accuracy", r6(c("accuracy"))).withColumn("weight", r6(c("weight")))
)

# F: windows

query("f01_transitions", f"SELECT playlist_id, position, a_id AS track_id, b_id AS next_id, {REL} AS relation, {SCORE} AS score, {LABEL} AS label, {RISK} AS risk, round(delta, 6) AS delta_pct FROM v_moves")(lambda v: harmony.transitions(gathered(v)).select("playlist_id", "position", "track_id", "next_id", "relation", "score", "label", "risk", r6(c("delta_pct")).alias("delta_pct")))
FLOW = f"SELECT set_id, position, CASE WHEN rn = 1 AND key_camelot IS NOT NULL THEN concat('Opening: ', key_camelot) WHEN rn = 1 THEN 'Opening (unmatched)' ELSE concat(coalesce(pk, '?'), ' → ', coalesce(key_camelot, '?')) END AS flow, CASE WHEN rn = 1 THEN NULL WHEN matched AND pm THEN concat('Track ', coalesce(pk, '?'), ' → ', coalesce(key_camelot, '?'), ': ', CASE WHEN coalesce(pk, '?') = coalesce(key_camelot, '?') THEN concat('Same key (', coalesce(pk, '?'), ')') ELSE concat('Key shift ', coalesce(pk, '?'), ' → ', coalesce(key_camelot, '?')) END, ', BPM ', coalesce(CAST(CAST(round_even(pb, 0) AS INT) AS STRING), '?'), ' → ', coalesce(CAST(CAST(round_even(bpm, 0) AS INT) AS STRING), '?')) ELSE 'Transition (unmatched tracks)' END AS transition FROM (SELECT *, lag(key_camelot) OVER w AS pk, lag(matched) OVER w AS pm, lag(bpm) OVER w AS pb, row_number() OVER w AS rn FROM ({LINES}) l WINDOW w AS (PARTITION BY set_id ORDER BY position)) x"
query("f02_setlist_flow", ALL(FLOW))(lambda v: sets.flow(lines(v)))
GRID = "SELECT track_id, source, bpm, row_number() OVER (PARTITION BY track_id ORDER BY is_override DESC, created_at DESC, source) AS rn FROM v_beat_grids"
active = lambda v: catalog.newest(v("v_beat_grids"), ["track_id"], [c("is_override").desc(), c("created_at").desc(), c("source")])
query("f03_active_grid", f"SELECT track_id, source, bpm FROM ({GRID}) x WHERE rn = 1")(lambda v: active(v).select("track_id", "source", "bpm"))
query("f04_newest_manifest", "SELECT track_id, source, created_at FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY created_at DESC, source) AS rn FROM v_opinions WHERE confidence >= 0.95) x WHERE rn = 1")(lambda v: catalog.newest(v("v_opinions").where("confidence >= 0.95"), ["track_id"], [c("created_at").desc(), c("source")]).select("track_id", "source", "created_at"))
query("f07_renumber", "SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY position) - 1 AS BIGINT) AS position FROM v_playlist_tracks WHERE position <> 1")(lambda v: sets.renumber(v("v_playlist_tracks").where("position <> 1")))
query("f08_key_journey", f"SELECT playlist_id, coalesce(string_agg(key_camelot, '>' ORDER BY position), '') AS journey FROM ({FULL}) x GROUP BY playlist_id")(lambda v: sets.key_journey(gathered(v)).select("playlist_id", F.array_join(F.filter("journey", lambda x: x.isNotNull()), ">").alias("journey")))
query("c29_trajectory", f"SELECT playlist_id, position, round((energy_level - 1) / 9.0, 6) AS energy, round((row_number() OVER (PARTITION BY playlist_id ORDER BY position) - 1) / CAST(greatest(count(*) OVER (PARTITION BY playlist_id) - 1, 1) AS DOUBLE), 6) AS fraction FROM ({FULL}) x")(lambda v: sets.trajectory(gathered(v)).select("playlist_id", "position", r6(c("energy")).alias("energy"), r6(c("fraction")).alias("fraction")))
query("f10_tap_tempo", "SELECT worker_id, ts, CASE WHEN m > 0 THEN CAST(floor(least(300.0, greatest(20.0, 60.0 / m)) + 0.5) AS BIGINT) END AS bpm FROM (SELECT worker_id, ts, avg(gap) OVER (PARTITION BY worker_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM (SELECT worker_id, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY worker_id ORDER BY ts) AS gap FROM (SELECT DISTINCT worker_id, ts FROM v_progress) d) g) x")(
    lambda v: sets.tap_tempo(v("v_progress").select("worker_id", "ts").distinct(), "worker_id")
)

# G: sorts and top-k

query("g01_library_page", f"SELECT track_id, filename, bpm FROM v_tracks ORDER BY bpm DESC NULLS LAST, track_id LIMIT 50 OFFSET 100")(lambda v: catalog.page(v("v_tracks"), "bpm", True, 50, 100).select("track_id", "filename", "bpm"))
query("g01_keyset_page", f"SELECT track_id, filename FROM v_tracks WHERE filename > 'm' ORDER BY filename, track_id LIMIT 50")(lambda v: catalog.page_after(v("v_tracks"), "filename", "m", 1 << 60, 50).select("track_id", "filename"))
TOTAL = "compat * 0.7 + (1 - least(abs(coalesce(bpm, coalesce(seed_bpm, 128)) - coalesce(seed_bpm, 128)), 20) / 20) * 0.3"
GENERATED = f"SELECT seed_id, track_id, place FROM (SELECT seed_id, track_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY round({TOTAL}, 9) DESC, track_id) AS INT) AS place FROM ({SEEDED}) y WHERE {TOTAL} > 0) z WHERE place < 10 UNION ALL SELECT seed_id, seed_id, 0 FROM ({SEEDS}) s"
generated = lambda v, s: harmony.generate_playlist(v("v_tracks"), s(v)).select("seed_id", "track_id", "place")
query("g02_generate_playlist", GENERATED)(lambda v: generated(v, seeds))
RANKED = "row_number() OVER (PARTITION BY track_id ORDER BY n DESC, best DESC, key_camelot)"
query("g04_top5_keys", f"SELECT track_id, key_camelot, n, rn AS rnk FROM ({MODAL}) m WHERE rn <= 5")(
    lambda v: (lambda k: k.withColumn("rnk", F.row_number().over(Window.partitionBy("track_id").orderBy(c("n").desc(), c("best").desc(), "key_camelot"))).where("rnk <= 5").select("track_id", "key_camelot", "n", "rnk"))(v("v_opinions").where("key_camelot is not null").groupBy("track_id", "key_camelot").agg(F.count("*").alias("n"), F.max("confidence").alias("best")))
)
SAME_KEY = f"SELECT seed_id, track_id, place FROM (SELECT s.seed_id, t.track_id, row_number() OVER (PARTITION BY s.seed_id ORDER BY abs(t.bpm - s.seed_bpm) NULLS LAST, t.track_id) AS place FROM ({SEEDS}) s JOIN v_tracks t ON t.key_camelot = s.seed_key AND t.track_id <> s.seed_id) x WHERE place < 20"
same_key = lambda v, s: harmony.same_key_playlist(v("v_tracks"), s(v))
query("g05_same_key_playlist", SAME_KEY)(lambda v: same_key(v, seeds))
query("g06_newest_first", f"SELECT annotation_id, created_at FROM v_gold ORDER BY created_at DESC, annotation_id DESC, track_id LIMIT 200")(lambda v: v("v_gold").orderBy(c("created_at").desc(), c("annotation_id").desc(), "track_id").limit(200).select("annotation_id", "created_at"))

# H: table maintenance

query("h01_upsert", "SELECT track_id, CASE WHEN track_id % 2 = 0 THEN 'X' ELSE key_camelot END AS key_camelot, bpm, CASE WHEN track_id % 2 = 0 THEN 'analyzed' ELSE status END AS status FROM v_tracks UNION ALL SELECT track_id + 10000000, 'X', NULL, 'analyzed' FROM v_tracks WHERE track_id % 2 = 0")(
    lambda v: (lambda t: catalog.upsert(t, t.where("track_id % 2 = 0").select("track_id", F.lit("X").alias("key_camelot"), F.lit(None).cast("double").alias("bpm"), F.lit("analyzed").alias("status")).transform(lambda u: u.unionByName(u.withColumn("track_id", c("track_id") + 10000000)).unionByName(u.withColumn("key_camelot", F.lit("old")).withColumn("status", F.lit("aaa")))), ["track_id"], "status", ["bpm"]))(v("v_tracks").select("track_id", "key_camelot", "bpm", "status"))
)
query("h02_replace_children", "SELECT playlist_id, track_id, position FROM v_playlist_tracks WHERE playlist_id % 3 <> 0 UNION ALL SELECT playlist_id, track_id, position FROM v_playlist_tracks WHERE playlist_id % 3 = 0 AND position < 2")(lambda v: (lambda p: catalog.replace_children(p, "playlist_id", p.where("playlist_id % 3 = 0 and position < 2")))(v("v_playlist_tracks")))
query("h03_delete_cascade", "SELECT 'track' AS kind, track_id, count(*) AS n FROM v_tracks WHERE track_id % 5 <> 0 GROUP BY track_id UNION ALL SELECT 'opinion', track_id, count(*) FROM v_opinions WHERE track_id % 5 <> 0 GROUP BY track_id UNION ALL SELECT 'session', CASE WHEN track_id % 5 <> 0 THEN track_id END, count(*) FROM v_gold GROUP BY 2")(
    lambda v: (lambda r: r[0].groupBy(F.lit("track").alias("kind"), "track_id").agg(F.count("*").alias("n")).unionByName(r[1]["o"].groupBy(F.lit("opinion").alias("kind"), "track_id").agg(F.count("*").alias("n"))).unionByName(r[1]["s"].groupBy(F.lit("session").alias("kind"), "track_id").agg(F.count("*").alias("n"))))(
        catalog.delete_cascade(v("v_tracks"), {"o": v("v_opinions"), "s": v("v_gold")}, "track_id", v("v_tracks").where("track_id % 5 = 0"), {"s"})
    )
)
query("h04_reset_overrides", "SELECT track_id, source FROM v_beat_grids WHERE NOT (is_override AND track_id % 2 = 0)")(lambda v: catalog.reset_overrides(v("v_beat_grids"), v("v_tracks").where("track_id % 2 = 0")).select("track_id", "source"))
query("h05_update_columns", "SELECT track_id, CASE WHEN track_id % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN track_id % 3 = 0 THEN 'metadata_ready' ELSE status END AS status FROM v_tracks")(lambda v: catalog.update_columns(v("v_tracks"), v("v_tracks").where("track_id % 3 = 0").select("track_id", F.lit(None).cast("string").alias("title")), ["title"], True, "metadata_ready").select("track_id", "title", "status"))
query("h06_append", "SELECT track_id, tonic_pc, key_mode FROM v_gold UNION ALL SELECT track_id, NULL, 'major' FROM v_tracks")(lambda v: catalog.append(v("v_gold").select("track_id", "tonic_pc", "key_mode"), v("v_tracks").select("track_id", F.lit("major").alias("key_mode"))))
query("a15_schema_evolution", "SELECT track_id, title, NULL AS genre FROM v_tracks UNION ALL SELECT track_id, NULL, genre_raw FROM v_genres")(lambda v: catalog.append(v("v_tracks").select("track_id", "title"), v("v_genres").select("track_id", c("genre_raw").alias("genre"))))
query("h07_merge_pages", "SELECT track_id, CAST(CASE WHEN track_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS page_no FROM v_tracks")(lambda v: (lambda t: catalog.merge_pages(t.select("track_id", F.lit(1).alias("page_no")).unionByName(t.where("track_id % 2 = 0").select("track_id", F.lit(2).alias("page_no")))))(v("v_tracks")))
TOKEN_SETS = f"SELECT set_id, position, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS every FROM (SELECT set_id, position, {TOK('title')} AS a, {TOK('artist')} AS b FROM v_setlist) x"
token_sets = lambda rows: rows.select("set_id", "position", text.tokens(c("title")).alias("a"), text.tokens(c("artist")).alias("b")).select("set_id", "position", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("every"))
query("h08_token_sets", ALL(TOKEN_SETS))(lambda v: token_sets(v("v_setlist_all")))
query("h09_mix_load", "SELECT playlist_id, position, track_id, CASE WHEN playlist_id % 2 = 0 AND position = 0 THEN 'first' END AS notes FROM v_playlist_tracks")(
    lambda v: catalog.load_mix(v("v_playlist_tracks").select("playlist_id").distinct().withColumn("rules", F.when(c("playlist_id") % 2 == 0, '{"type":"mix","clipNotes":[{"position":0,"notes":"first"}]}').otherwise("not json")), v("v_playlist_tracks"))
)
query("i33_split", "SELECT track_id, (row_number() OVER (PARTITION BY key_camelot ORDER BY md5(concat('7', CAST(track_id AS STRING))), track_id) - 1) % 5 AS fold FROM v_tracks")(lambda v: evaluation.split(v("v_tracks"), "key_camelot", "track_id", 7, 5).select("track_id", "fold"))


@query("l04_greedy_paths")
def _(v):
    best = harmony.next_candidates(v("v_tracks"), n=5)
    return harmony.paths(best, v("v_tracks"), 6)
