"""Scalar functions C1 to C30."""

from pyspark.sql import functions as F

from ..functions import keys, scoring, text
from .registry import query, r6

c = F.col
PAIR = ["playlist_id", "position"]

query("c01_key_to_camelot", "SELECT annotation_id, tonic_pc, key_mode, created_at, d.code FROM v_gold g LEFT JOIN v_dim d ON d.tonic = g.tonic_pc AND d.is_major = (g.key_mode = 'major')")(
    lambda v: v("v_gold").select("annotation_id", "tonic_pc", "key_mode", "created_at", keys.key_to_camelot(c("tonic_pc"), c("key_mode") == "major").alias("code"))
)
query("c02_parse_camelot", "SELECT t.track_id, d.n AS num, d.is_major FROM v_tracks t LEFT JOIN v_dim d ON d.code = t.key_camelot")(
    lambda v: v("v_tracks").select("track_id", keys.number(c("key_camelot")).alias("num"), keys.is_major(c("key_camelot")).alias("is_major"))
)
NAMES = "(VALUES (0,'C'),(1,'C#'),(2,'D'),(3,'D#'),(4,'E'),(5,'F'),(6,'F#'),(7,'G'),(8,'G#'),(9,'A'),(10,'A#'),(11,'B')) AS nm(pc, note)"
STD = f"SELECT t.track_id, d.code, d.tonic, d.is_major, concat(nm.note, CASE WHEN d.is_major THEN ' major' ELSE ' minor' END) AS name FROM v_tracks t JOIN v_dim d ON d.code = t.key_camelot JOIN {NAMES} ON nm.pc = d.tonic"
query("c03_camelot_to_standard", f"SELECT track_id, tonic, name FROM ({STD}) x")(
    lambda v: v("v_tracks").where("key_camelot is not null").select("track_id", keys.tonic(c("key_camelot")).alias("tonic"), keys.camelot_to_standard(c("key_camelot")).alias("name"))
)
query("c04_standard_to_camelot", f"SELECT track_id, name, code FROM ({STD}) x")(
    lambda v: v("v_tracks").where("key_camelot is not null").select("track_id", keys.camelot_to_standard(c("key_camelot")).alias("name")).withColumn("code", keys.standard_to_camelot(c("name")))
)


@query("c05_parse_standard_key", f"SELECT track_id, tonic, is_major FROM ({STD}) x")
def _(v):
    t, m = keys.parse_standard(F.concat(F.lower("name"), F.lit("\t0.9")))
    named = v("v_tracks").where("key_camelot is not null").select("track_id", keys.camelot_to_standard(c("key_camelot")).alias("name"))
    return named.select("track_id", t.alias("tonic"), m.alias("is_major"))


query("c06_xml_key_code", "SELECT track_id, CASE WHEN k < 12 THEN concat(CAST((k + 7) % 12 + 1 AS STRING), 'B') WHEN k < 24 THEN concat(CAST((k - 12 + 4) % 12 + 1 AS STRING), 'A') END AS code FROM (SELECT track_id, CAST(track_id % 26 AS INT) AS k FROM v_tracks) x")(
    lambda v: v("v_tracks").select("track_id", keys.xml_key(c("track_id") % 26).alias("code"))
)


@query("c07_label24", "SELECT annotation_id, created_at, tonic_pc + (CASE WHEN key_mode = 'major' THEN 0 ELSE 12 END) AS label, tonic_pc AS tonic, key_mode = 'major' AS is_major FROM v_gold")
def _(v):
    got = v("v_gold").withColumn("label", keys.label24(c("tonic_pc"), c("key_mode") == "major"))
    t, m = keys.from_label24(c("label"))
    return got.select("annotation_id", "created_at", "label", t.alias("tonic"), m.alias("is_major"))


OFFSETS = "(VALUES (0),(1),(11),(2),(10)) AS o(k)"
PARTNERS = f"SELECT t.track_id, concat(CAST((t.n - 1 + o.k) % 12 + 1 AS STRING), t.c) AS partner FROM v_keys t CROSS JOIN {OFFSETS} UNION ALL SELECT track_id, concat(CAST(n AS STRING), CASE WHEN c = 'A' THEN 'B' ELSE 'A' END) FROM v_keys"
query("c08_compatible_positions", PARTNERS)(lambda v: v("v_tracks").where("key_camelot is not null").select("track_id", F.explode(keys.compatible_positions(c("key_camelot"))).alias("partner")))

REL = "CASE WHEN d IS NULL THEN 'unknown' WHEN d = 0 AND same THEN 'same-key' WHEN d = 0 THEN 'mood-shift' WHEN NOT same THEN 'bridge-needed' WHEN d IN (1, 11) THEN 'neighbor' WHEN d = 2 THEN 'energy-boost' WHEN d = 10 THEN 'energy-drop' ELSE 'tension' END"
rel = lambda: keys.relation(c("ak"), c("bk"))  # noqa: E731  no Column is made before there is a session
query("c09_relationship", f"SELECT playlist_id, position, rel, CASE rel WHEN 'same-key' THEN 'Same key' WHEN 'neighbor' THEN 'Neighbor move' WHEN 'mood-shift' THEN 'Mood shift' WHEN 'energy-boost' THEN 'Energy boost' WHEN 'energy-drop' THEN 'Energy drop' WHEN 'tension' THEN 'Tension jump' WHEN 'bridge-needed' THEN 'Bridge needed' ELSE 'Unknown' END AS label FROM (SELECT *, {REL} AS rel FROM v_moves) x")(
    lambda v: v("v_pairs").select(*PAIR, rel().alias("rel")).withColumn("label", keys.relation_label(c("rel")))
)
POS = "CASE WHEN d IS NULL THEN NULL WHEN d = 0 AND same THEN 'same' WHEN d = 0 THEN 'mood_shift' WHEN NOT same THEN 'incompatible' WHEN d = 1 THEN 'plus_one' WHEN d = 11 THEN 'minus_one' WHEN d = 2 THEN 'plus_two' WHEN d = 10 THEN 'minus_two' ELSE 'incompatible' END"
query("c10_position_relation", f"SELECT playlist_id, position, {POS} AS pos FROM v_moves")(lambda v: v("v_pairs").select(*PAIR, keys.position(c("ak"), c("bk")).alias("pos")))
COMPAT = "CASE WHEN d IS NULL THEN 0.0 WHEN d = 0 AND same THEN 1.0 WHEN same AND d IN (1, 11) THEN 0.9 WHEN same AND d IN (2, 10) THEN 0.7 WHEN NOT same AND d = 0 THEN 0.8 WHEN NOT same AND ((ac = 'A' AND d = 11) OR (ac = 'B' AND d = 1)) THEN 0.6 ELSE 0.0 END"
query("c11_rule_compatibility", f"SELECT playlist_id, position, CAST({COMPAT} AS DOUBLE) AS compat FROM v_moves")(lambda v: v("v_pairs").select(*PAIR, keys.compatibility(c("ak"), c("bk")).alias("compat")))
BASE = f"CASE {REL} WHEN 'same-key' THEN 95 WHEN 'neighbor' THEN 85 WHEN 'mood-shift' THEN 80 WHEN 'energy-boost' THEN 75 WHEN 'energy-drop' THEN 70 WHEN 'tension' THEN 40 WHEN 'bridge-needed' THEN 20 ELSE 0 END"
SCORE = f"CAST(greatest(0, {BASE} - CASE WHEN abs(delta) > 6 THEN least(20, floor((abs(delta) - 6) * 2 + 0.5)) ELSE 0 END) AS INT)"
RISK = f"CASE WHEN {REL} IN ('same-key', 'neighbor', 'mood-shift') THEN 'low' WHEN {REL} IN ('energy-boost', 'energy-drop') THEN 'medium' ELSE 'high' END"


@query("c12_transition_score", f"SELECT playlist_id, position, {SCORE} AS score, {RISK} AS risk, round(delta, 6) AS delta_pct FROM v_moves")
def _(v):
    d = keys.delta_percent(c("abpm"), c("bbpm"))
    known = {"base": (lambda a, b: keys.base_score(keys.relation(a, b)), 0), "risk": (lambda a, b: keys.relation_risk(keys.relation(a, b)), "high")}
    return keys.by_codes(v("v_pairs"), "ak", "bk", known).select(*PAIR, keys.less_jump(c("base"), d).alias("score"), "risk", r6(d).alias("delta_pct"))


query("c13_compatibility_strength", "SELECT playlist_id, position, coalesce((same AND d IN (0, 1, 2, 10, 11)) OR (NOT same AND d = 0), false) AS ok, CASE WHEN d IS NULL THEN 0 WHEN d = 0 AND same THEN 3 WHEN d = 0 THEN 2 WHEN same AND d IN (1, 11) THEN 2 WHEN same AND d IN (2, 10) THEN 1 ELSE 0 END AS strength FROM v_moves")(
    lambda v: keys.by_codes(v("v_pairs"), "ak", "bk", {"ok": (keys.is_compatible, False), "strength": (keys.strength, 0)}).select(*PAIR, "ok", "strength")
)


@query("c14_key_ambiguity", "SELECT m.playlist_id, m.position, CASE WHEN m.ak = m.bk THEN 'same' WHEN a.tonic = b.tonic THEN 'parallel' WHEN a.n = b.n THEN 'relative' WHEN same AND abs(a.n - b.n) IN (1, 11) THEN 'close_wheel' WHEN same AND (b.tonic - a.tonic + 12) % 12 = 7 THEN 'dominant' WHEN same AND (b.tonic - a.tonic + 12) % 12 = 5 THEN 'subdominant' ELSE 'distant' END AS kind FROM v_moves m JOIN v_dim a ON a.code = m.ak JOIN v_dim b ON b.code = m.bk")
def _(v):
    return keys.by_codes(v("v_pairs").where("ak is not null and bk is not null"), "ak", "bk", {"kind": (keys.ambiguity, "distant")}, of="name").select(*PAIR, "kind")


DIFF = "(pt - tt + 12) % 12"
MIREX = f"CASE WHEN pt = tt AND pm = tm THEN 1.0 WHEN pm = tm AND {DIFF} IN (5, 7) THEN 0.5 WHEN tm AND NOT pm AND {DIFF} = 9 THEN 0.3 WHEN NOT tm AND pm AND {DIFF} = 3 THEN 0.3 WHEN pt = tt AND pm <> tm THEN 0.2 ELSE 0.0 END"
ERR = f"CASE WHEN pt = tt AND pm = tm THEN 'correct' WHEN pt = tt THEN 'parallel' WHEN (tm AND NOT pm AND {DIFF} = 9) OR (NOT tm AND pm AND {DIFF} = 3) THEN 'relative' WHEN pm = tm AND {DIFF} IN (5, 7) THEN 'fifth' WHEN {DIFF} IN (1, 11) THEN 'semitone' ELSE 'other' END"
BOTH = "tt IS NOT NULL AND pt IS NOT NULL"
mir = lambda: scoring.mirex(c("pt"), c("pm"), c("tt"), c("tm"))


def scored(v):
    """Predictions with tonic and mode of truth and prediction."""
    p = v("v_predictions")
    t, q = c("truth_camelot"), c("pred_camelot")
    return p.select("*", keys.tonic(t).alias("tt"), keys.is_major(t).alias("tm"), keys.tonic(q).alias("pt"), keys.is_major(q).alias("pm"))


query("c15_mirex", f"SELECT track_id, CAST({MIREX} AS DOUBLE) AS mirex FROM v_scored WHERE {BOTH}")(lambda v: scored(v).where(BOTH).select("track_id", mir().alias("mirex")))
query("c16_error_class", f"SELECT track_id, {ERR} AS error FROM v_scored WHERE {BOTH}")(lambda v: scored(v).where(BOTH).select("track_id", scoring.error_class(c("pt"), c("pm"), c("tt"), c("tm")).alias("error")))
query("c17_compatible_flag", f"SELECT track_id, {MIREX} > 0 AS compatible FROM v_scored WHERE {BOTH}")(lambda v: scored(v).where(BOTH).select("track_id", (mir() > 0).alias("compatible")))
_e = lambda m: f"(pred_bpm * {m} - truth_bpm)"
query("c18_bpm_agreement", f"SELECT track_id, abs({_e('1.0')}) <= 1 AS raw, abs({_e('0.5')}) <= 1 OR abs({_e('1.0')}) <= 1 OR abs({_e('2.0')}) <= 1 AS octave, round(CASE WHEN abs({_e('0.5')}) <= abs({_e('1.0')}) AND abs({_e('0.5')}) <= abs({_e('2.0')}) THEN {_e('0.5')} WHEN abs({_e('1.0')}) <= abs({_e('2.0')}) THEN {_e('1.0')} ELSE {_e('2.0')} END, 6) AS error, round(pred_bpm / truth_bpm, 6) AS ratio FROM (SELECT track_id, CAST(pred_bpm AS DOUBLE) AS pred_bpm, CAST(truth_bpm AS DOUBLE) AS truth_bpm FROM v_predictions) p WHERE pred_bpm IS NOT NULL AND truth_bpm IS NOT NULL")(
    lambda v: v("v_predictions").where("pred_bpm is not null and truth_bpm is not null").select("track_id", scoring.within_one(c("pred_bpm"), c("truth_bpm"), False).alias("raw"), scoring.within_one(c("pred_bpm"), c("truth_bpm"), True).alias("octave"), r6(scoring.best_octave_error(c("pred_bpm"), c("truth_bpm"))).alias("error"), r6(scoring.bpm_ratio(c("pred_bpm"), c("truth_bpm"))).alias("ratio"))
)
# fixed values, written out once more so that the SQL knows nothing of the library's tables
GENRE = """CASE WHEN g IN ('', 'unknown', 'unknown genre', 'unclassifiable', 'various') THEN 'unknown' WHEN regexp_matches(g, 'electr|edm|dance') THEN 'electronic' WHEN regexp_matches(g, 'house') THEN 'house'
WHEN regexp_matches(g, 'techno') THEN 'techno' WHEN regexp_matches(g, 'trance|psy') THEN 'trance' WHEN regexp_matches(g, 'dubstep|drum|bass|riddim') THEN 'bass' WHEN regexp_matches(g, 'hip|hop|rap|trap') THEN 'hip-hop'
WHEN regexp_matches(g, 'r&b|r''n''b|r-n-b|soul|funk') THEN 'r&b' WHEN regexp_matches(g, 'rock|punk|metal|guitar') THEN 'rock' WHEN regexp_matches(g, 'pop|top 40|top40') THEN 'pop'
WHEN regexp_matches(g, 'reggae|dancehall|shatta|salsa|latin|ragga') THEN 'reggae-latin' WHEN regexp_matches(g, 'classical|orchestr|soundtrack|score|theme|anime') THEN 'classical' WHEN regexp_matches(g, 'jazz|blues|swing') THEN 'jazz'
WHEN regexp_matches(g, 'chill|ambient|lounge') THEN 'ambient' WHEN regexp_matches(g, 'world|folk|acoustic|country') THEN 'world' ELSE 'other' END"""
query("c19_normalize_genre", f"SELECT track_id, {GENRE} AS genre FROM (SELECT track_id, lower(trim(coalesce(genre_raw, ''))) AS g FROM v_genres) x")(lambda v: v("v_genres").select("track_id", text.normalize_genre(c("genre_raw")).alias("genre")))
# fixed values: krumhansl, temperley, shaath
WEIGHED = """CASE WHEN g = '' THEN [0.15, 0.25, 1.0] WHEN regexp_matches(g, 'electronic|edm|house|techno|trance|dubstep|drum & bass|dnb|garage|bass|disco|synth|ambient|idm|breakbeat|electro|minimal') THEN [0.3, 0.4, 0.6]
WHEN regexp_matches(g, 'classical|orchestral|symphony|baroque|chamber|opera|piano|string quartet|concerto') THEN [0.6, 0.5, 0.3] WHEN regexp_matches(g, 'rock|pop|indie|alternative|punk|metal|folk|country|blues') THEN [0.3, 0.6, 0.4]
WHEN regexp_matches(g, 'hip|hop|rap|r&b|rnb|soul|trap|funk') THEN [0.2, 0.4, 0.5] WHEN regexp_matches(g, 'jazz|swing|bebop|fusion|smooth jazz') THEN [0.5, 0.5, 0.3] ELSE [0.15, 0.25, 1.0] END"""
_w = lambda i: f"({WEIGHED})[{i + 1}]"
query("c20_genre_weights", f"SELECT track_id, CAST({_w(0)} AS DOUBLE) AS krumhansl, CAST({_w(1)} AS DOUBLE) AS temperley, CAST({_w(2)} AS DOUBLE) AS shaath FROM (SELECT track_id, lower(coalesce(genre_raw, '')) AS g FROM v_genres) x")(
    lambda v: v("v_genres").select("track_id", text.profile_weights(c("genre_raw")).alias("w")).select("track_id", "w.*")
)
NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
query("c21_normalize_text", f"SELECT set_id, position, {NORM('title')} AS norm FROM v_setlist_all")(lambda v: v("v_setlist_all").select("set_id", "position", text.normalize_text(c("title")).alias("norm")))
TOK = lambda x: f"list_distinct(string_split({NORM(x)}, ' '))"
query("c22_token_jaccard", f"SELECT set_id, position, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS sim FROM (SELECT set_id, position, {TOK('title')} AS a, {TOK('artist')} AS b FROM v_setlist_all) x")(
    lambda v: v("v_setlist_all").select("set_id", "position", r6(text.jaccard(text.tokens(c("title")), text.tokens(c("artist")))).alias("sim"))
)


@query("c23_parse_filename", "SELECT track_id, artist, title FROM (SELECT track_id, CASE WHEN artist = 'Unknown Artist' THEN '' ELSE artist END AS artist, concat(coalesce(title, 'x'), ' ', CAST(track_id AS STRING)) AS title FROM v_tracks) x")
def _(v):
    named = v("v_tracks").select("track_id", F.when(c("artist") == "Unknown Artist", F.concat(c("track_id"), F.lit(". "), F.coalesce("title", F.lit("x")), F.lit(" "), c("track_id"), F.lit(".mp3"))).otherwise(F.concat(c("artist"), F.lit(" - "), F.coalesce("title", F.lit("x")), F.lit(" "), c("track_id"), F.lit(".mp3"))).alias("f"))
    artist, title = text.parse_filename(c("f"))
    return named.select("track_id", artist.alias("artist"), title.alias("title"))


query("c24_path_normalize", "SELECT track_id, replace(file_path, '/', chr(92)) AS path, filename AS base FROM v_tracks")(lambda v: v("v_tracks").select("track_id", text.normalize_path(c("file_path")).alias("path"), text.basename(c("file_path")).alias("base")))
LABEL = f"CASE {REL} WHEN 'same-key' THEN 'Same key' WHEN 'neighbor' THEN 'Neighbor move' WHEN 'mood-shift' THEN 'Mood shift' WHEN 'energy-boost' THEN 'Energy boost' WHEN 'energy-drop' THEN 'Energy drop' WHEN 'tension' THEN 'Tension jump' WHEN 'bridge-needed' THEN 'Bridge needed' ELSE 'Unknown' END"
query("c25_transition_sentence", f"SELECT playlist_id, position, concat({LABEL}, CASE WHEN dd IS NULL THEN ' BPM unknown.' WHEN dd < 2 THEN ' BPM is nearly matched.' WHEN dd < 8 THEN concat(' BPM shifts ', CAST(CAST(round_even(dd, 0) AS INT) AS STRING), '% — manageable.') ELSE concat(' BPM jumps ', CAST(CAST(round_even(dd, 0) AS INT) AS STRING), '% — risky without pitch adjustment.') END) AS sentence FROM (SELECT *, abs((bbpm - abpm) / abpm * 100) AS dd FROM v_moves) x")(
    lambda v: v("v_pairs").select(*PAIR, text.transition_sentence(c("ak"), c("bk"), c("abpm"), c("bbpm")).alias("sentence"))
)
query("c26_transition_dimensions", f"SELECT playlist_id, position, CASE WHEN {POS} IS NULL THEN 'warn' WHEN {POS} IN ('same', 'plus_one', 'minus_one') THEN 'good' WHEN {POS} = 'incompatible' THEN 'risk' ELSE 'ok' END AS harmonic, CASE WHEN abpm IS NULL OR bbpm IS NULL THEN 'warn' WHEN abs(abpm - bbpm) / least(abpm, bbpm) < 0.02 THEN 'good' WHEN abs(abpm - bbpm) / least(abpm, bbpm) < 0.08 THEN 'ok' ELSE 'warn' END AS tempo, CASE WHEN ae IS NULL OR be IS NULL THEN 'warn' WHEN be - ae > 2 THEN 'good' ELSE 'ok' END AS energy FROM v_moves")(
    lambda v: keys.by_codes(v("v_pairs"), "ak", "bk", {"h": (text.harmonic_verdict, "warn")}).select(*PAIR, text.verdicts(c("h"), c("abpm"), c("bbpm"), c("ae"), c("be")).alias("x")).select(*PAIR, "x.*")
)


@query("c27_mix_notes", "SELECT playlist_id, CAST(position AS INT) AS position, concat('n', CAST(track_id AS STRING)) AS notes FROM v_playlist_tracks")
def _(v):
    clips = v("v_playlist_tracks").groupBy("playlist_id").agg(F.sort_array(F.collect_list(F.struct(c("position").cast("int").alias("position"), F.concat(F.lit("n"), c("track_id")).alias("notes")))).alias("clips"))
    back = clips.select("playlist_id", text.build_notes(c("clips")).alias("rules")).select("playlist_id", F.explode(text.parse_notes(c("rules"))).alias("n"))
    return back.select("playlist_id", "n.position", "n.notes")


@query("c28_plan_json", "SELECT playlist_id, position, round(abpm, 6) AS master_bpm, CAST(position % 4 * 8 AS DOUBLE) AS overlap_beats, CASE WHEN position % 2 = 0 THEN 'a' ELSE 'b' END AS tempo_master FROM v_pairs")
def _(v):
    plans = v("v_pairs").select(*PAIR, F.to_json(F.struct((c("position") % 4 * 8).alias("overlap_beats"), c("abpm").alias("master_bpm"), F.when(c("position") % 2 == 0, "a").otherwise("b").alias("tempo_master"))).alias("js"))
    return plans.select(*PAIR, text.parse_plan(c("js")).alias("p")).select(*PAIR, r6(c("p.master_bpm")).alias("master_bpm"), "p.overlap_beats", "p.tempo_master")


query("c30_tempo_preference", "SELECT track_id, round(exp(-0.5 * pow(log2(bpm / 120.0), 2)), 6) AS pref FROM v_tracks WHERE bpm IS NOT NULL")(lambda v: v("v_tracks").where("bpm is not null").select("track_id", r6(scoring.tempo_preference(c("bpm"))).alias("pref")))
