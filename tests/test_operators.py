"""Fixed vectors, invariants, sources, sinks and streams of the catalog."""

import datetime

from pyspark.sql import functions as F

from spinlattice.functions import keys, scoring, text
from spinlattice.operators import catalog, consensus, evaluation, harmony, sets, signal
from spinlattice.sources import files
from spinlattice.streaming import jobs

c = F.col


def test_all_keys_there_and_back(spark):
    rows = keys.dim_key(spark).select("*", keys.key_to_camelot(c("tonic"), c("is_major")).alias("k"), keys.tonic(c("code")).alias("t"), keys.standard_to_camelot(c("name")).alias("s"), keys.camelot_to_standard(c("code")).alias("n")).collect()
    assert len(rows) == 24 and all(r["k"] == r["code"] == r["s"] and r["t"] == r["tonic"] and r["n"] == r["name"] for r in rows)
    assert {(r["tonic"], r["is_major"]): r["code"] for r in rows}[(9, False)] == "8A"


def test_parsing_is_strict_about_codes(spark):
    df = spark.createDataFrame([("8A",), (" 12b ",), ("13A",), ("0A",), ("A8",), ("",), (None,), ("8C",)], "k string")
    assert [r["n"] for r in df.select(keys.number(c("k")).alias("n")).collect()] == [8, 12] + [None] * 6
    names = spark.createDataFrame([("Eb minor",), ("g# MAJOR\t0.5",), ("H minor",), ("C",)], "k string")
    t, m = keys.parse_standard(c("k"))
    assert [tuple(r) for r in names.select(t, m).collect()] == [(3, False), (8, True), (None, None), (None, None)]


def test_scores(spark):
    df = spark.createDataFrame([(0, True, 0, True), (7, True, 0, True), (5, True, 0, True), (9, False, 0, True), (3, True, 0, False), (0, False, 0, True), (1, True, 0, True), (6, True, 0, True)], "pt int, pm boolean, tt int, tm boolean")
    args = [c(x) for x in ("pt", "pm", "tt", "tm")]
    got = df.select(scoring.mirex(*args).alias("m"), scoring.error_class(*args).alias("e"), scoring.mirex_one_sided(*args).alias("o")).collect()
    assert [r["m"] for r in got] == [1.0, 0.5, 0.5, 0.3, 0.3, 0.2, 0.0, 0.0]
    assert [r["e"] for r in got] == ["correct", "fifth", "fifth", "relative", "relative", "parallel", "semitone", "other"]
    assert got[1]["o"] == 0.5 and got[2]["o"] == 0.0


def test_genres_and_texts(spark):
    raw = ["Tech House", "Dancehall", "Trap", "", None, "Psy-Trance", "Drum & Bass", "Top 40", "Blues", "???"]
    got = spark.createDataFrame([(g,) for g in raw], "g string").select(text.normalize_genre(c("g"))).collect()
    assert [r[0] for r in got] == ["house", "electronic", "hip-hop", "unknown", "unknown", "trance", "bass", "pop", "jazz", "other"]
    a, t = text.parse_filename(c("f"))
    rows = spark.createDataFrame([("1 Foo - Bar.mp3",), ("Foo_-_Bar.flac",), ("01_Song.wav",)], "f string").select(a, t).collect()
    assert [tuple(r) for r in rows] == [("Foo", "Bar"), ("Foo", "Bar"), ("", "Song")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 2)], "id long, v string, at int")
    once = catalog.upsert(old, new, ["id"], "at")
    twice = catalog.upsert(once, new, ["id"], "at")
    want = [(1, "a", 1), (2, "y", 3), (3, "z", 2)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_consensus_ties(spark):
    rows = [(1, "engine", "8A", 120.0, 0.5), (1, "tagcsv", "9A", 122.0, 0.9), (2, "engine", None, None, None), (3, "engine", "1A", 100.0, 0.1), (3, "djxml", "1A", 101.0, 0.2)]
    got = {r["track_id"]: r for r in consensus.consensus(spark.createDataFrame(rows, "track_id long, source string, key_camelot string, bpm double, confidence double")).collect()}
    assert (got[1]["key_camelot"], got[1]["bpm"], got[1]["status"]) == ("9A", 122.0, "contested")
    assert (got[2]["key_camelot"], got[2]["bpm"], got[2]["status"]) == (None, None, "single")
    assert (got[3]["status"], got[3]["agreeing"], got[3]["bpm_agreeing"]) == ("agreed", 2, 2)


def test_neighbours_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, f"{rng.randint(1, 12)}{rng.choice('AB')}", 60 + rng.random() * 120) for i in range(120)] + [(500, None, 100.0), (501, "8A", None)]
    df = spark.createDataFrame(rows, "track_id long, key_camelot string, bpm double")
    got = {(r["track_id"], r["other_id"]) for r in harmony.neighbours(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    brute = a.crossJoin(b).where("a.track_id <> b.track_id and abs(b.bpm - a.bpm) / a.bpm <= 0.06").where(keys.is_compatible(c("a.key_camelot"), c("b.key_camelot")))
    assert got == {(r[0], r[1]) for r in brute.select("a.track_id", "b.track_id").collect()}


def test_sampler(spark):
    rows = spark.createDataFrame([(f"h{i}", "house") for i in range(50)] + [(f"j{i}", "jazz") for i in range(5)], "location string, genre string")
    pick = lambda seed, n: [r["location"] for r in evaluation.stratified_sample(rows, seed, n).collect()]
    assert pick(1, 10) == pick(1, 10) and set(pick(1, 10)) != set(pick(2, 10))
    assert sum(x.startswith("j") for x in pick(1, 20)) == 5 and len(pick(1, 99)) == 55


def test_click_track_tempo(spark):
    step = 20
    rows = [(1, f, 1.0 if f % step == 0 else 0.0) for f in range(800)]
    onset = spark.createDataFrame(rows, "track_id long, frame int, onset double")
    ac = signal.autocorrelation(onset, 64)
    top = signal.peaks(ac, 8, 62)
    got = signal.tempo(top, onset).first()
    assert abs(got["bpm"] - 60 * signal.FRAME_RATE / step) < 1.5
    joined = {(r["lag"]): r["value"] for r in signal.autocorrelation_by_join(onset, 64).collect()}
    assert all(abs(joined.get(r["lag"], 0.0) - r["value"]) < 1e-9 for r in ac.collect())


def test_spectrum_and_chroma_find_a(spark):
    import math

    rate, n = 4096.0, 1024
    frames = spark.createDataFrame([(1, 0, [math.sin(2 * math.pi * 440 * i / rate) for i in range(n)])], "track_id long, frame int, samples array<double>")
    spec = signal.spectrum(frames).select("track_id", "frame", F.posexplode("mags").alias("bin", "mag"))
    best = signal.fold(spec, signal.bin_map(spark, n // 2, n, rate)).orderBy(c("value").desc()).first()
    assert best["pc"] == 9
    assert signal.energy(frames, 4096).first()["energy_level"] >= 1


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MP3").write_bytes(b"abc")
    (tmp_path / "a" / "x.txt").write_bytes(b"no")
    listed = files.media_files(spark, str(tmp_path / "a"))
    assert [(r["filename"], r["extension"], r["file_size"]) for r in listed.collect()] == [("x.MP3", "mp3", 3)]
    head = "Title,Artist,Key,Tempo,Genre,Album,Grouping,Date Added,Location,Comment,Year,Overall Volume,Energy,CuePoints,ClippedPeaks\n"
    (tmp_path / "l.csv").write_text("﻿" + head + "T,A,8A,128.5,House,,,,C:\\m\\t.mp3,,,,7,,\nU,B,All,0,,,,,/m/u.flac,,,,x,,\nV,B,,,,,,,,,,,,,\n", encoding="utf-8")
    got = files.label_csv(spark, str(tmp_path / "l.csv")).orderBy("title").collect()
    assert [(r["key"], r["bpm"], r["energy"], r["extension"]) for r in got] == [("8A", 128.5, 7, "mp3"), ("All", None, None, "flac")]
    (tmp_path / "c.xml").write_text('<NML><COLLECTION><ENTRY TITLE="T" ARTIST="A"><LOCATION FILE="t.mp3" DIR="/:m/:"/><TEMPO BPM="120.0"/><MUSICAL_KEY VALUE="21"/></ENTRY></COLLECTION></NML>')
    r = files.collection_xml(spark, str(tmp_path / "c.xml")).first()
    assert (r["location"], r["key_camelot"], r["bpm"]) == ("/m/t.mp3", "2A", 120.0)
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "s1.key").write_text("Eb minor")
    (tmp_path / "ann" / "s1.genre").write_text("house")
    r = files.annotation_folder(spark, str(tmp_path / "ann"), listed.select(F.lit("/x/s1.mp3").alias("path"))).first()
    assert (r["stem"], r["tonic"], r["is_major"], r["genre_raw"], r["status"]) == ("s1", 3, False, "house", "ready")
    (tmp_path / "1.jams").write_text('{"annotations":[{"namespace":"key_mode","data":[{"time":0,"duration":1,"confidence":0.5,"value":"C:minor"}]},{"namespace":"tag_open","data":[{"value":"techno"}]}],"file_metadata":{"duration":120.5}}')
    r = files.jams(spark, str(tmp_path / "1.jams")).first()
    assert (r["stem"], r["key"], r["confidence"], r["genre_raw"], r["duration"]) == ("1", "C:minor", 0.5, "techno", 120.5)
    (tmp_path / "a.tsv").write_text("ID\tMANUAL KEY\tC\n7\tF minor / G# major\t2\n8\t\t0\n")
    got = files.annotation_tsv(spark, str(tmp_path / "a.tsv")).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["ordinal"], r["tonic"]) for r in got] == [("7", 0, 5), ("7", 1, 8), ("8", None, None)]
    (tmp_path / "md5").mkdir()
    (tmp_path / "md5" / "x.md5").write_text("900150983cd24fb0d6963f7d28e17f72  x.mp3")
    (tmp_path / "au").mkdir()
    (tmp_path / "au" / "x.mp3").write_bytes(b"abc")
    (tmp_path / "au" / "y.mp3").write_bytes(b"abc")
    for stem in "yz":
        (tmp_path / "md5" / f"{stem}.md5").write_text("9" * 32)
    (tmp_path / "au" / "w.mp3").write_bytes(b"q")
    assert {r["stem"]: r["status"] for r in files.integrity(spark, str(tmp_path / "au"), str(tmp_path / "md5")).collect()} == {"x": "intact", "y": "altered", "z": "missing", "w": "extra"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 'a "q"', "A", "f.mp3", "/f.mp3", 61500, "8A", 120.0, 5, 0.875)], "playlist_id long, position long, title string, artist string, filename string, file_path string, duration_ms long, key_camelot string, bpm double, energy_level int, key_confidence double")
    sets.write_m3u8(rows, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["#EXTM3U", '#EXTINF:61,A - a "q"', "/f.mp3"]
    sets.write_tracklist(rows, str(tmp_path / "t"))
    text_ = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert '"a ""q"""' in text_[1] and '"88%"' in text_[1]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.mp3").write_bytes(b"abc")
    seen = []
    jobs.run(jobs.listing(spark, str(tmp_path / "in")), lambda df, i: seen.extend(r["filename"] for r in df.collect()), str(tmp_path / "ck"))
    assert seen == ["x.mp3"]
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(at(i), 1, i % 2, i == 3) for i in range(8)], "ts timestamp, session_id long, track_id long, failed boolean")
    events.write.parquet(str(tmp_path / "ev"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))

    def drain(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    last = {r["track_id"]: r["ts"] for r in drain(jobs.latest(stream()), "last", "complete").collect()}
    assert last == {0: at(6), 1: at(7)}
    rate = drain(jobs.throughput(stream(), 80), "rate", "complete").first()
    assert (rate["n"], rate["failed"], rate["eta_minutes"]) == (8, 1, 10.0)
    tracks = spark.createDataFrame([(1, None, None, "pending"), (2, None, None, "pending")], "track_id long, key_camelot string, bpm double, status string")
    opinions = spark.createDataFrame([], "track_id long, source string, key_camelot string, bpm double, confidence double, at timestamp")
    results = spark.createDataFrame([(1, "8A", 120.0, 0.9, at(1)), (1, "9A", 121.0, 0.8, at(2))], "track_id long, key_camelot string, bpm double, confidence double, at timestamp")
    t, o = jobs.apply_results(tracks, opinions, results)
    t2, o2 = jobs.apply_results(t, o, results)
    assert sorted(map(tuple, t2.collect())) == sorted(map(tuple, t.collect())) == [(1, "9A", 121.0, "analyzed"), (2, None, None, "pending")]
    assert o2.count() == 1


def test_next_candidates_with_used_partners_and_few_codes(spark):
    """All relations, used partners last within a score, tempos that are null, against pairs by hand."""
    import random

    rng = random.Random(3)
    for codes in (["8A", "8A", "9A", "3B"], ["1A", "5B"], [f"{n}{x}" for n in range(1, 13) for x in "AB"]):
        rows = [(i, rng.choice(codes), None if rng.random() < 0.1 else rng.choice([0.0, 100.0, 100.0, 102.5, 120.0, rng.uniform(60, 180)])) for i in range(90)] + [(500, None, 100.0)]
        df = spark.createDataFrame(rows, "track_id long, key_camelot string, bpm double")
        used = {(i, rng.randrange(90)) for i in range(90) for _ in range(rng.choice([0, 0, 5]))}
        got = harmony.next_candidates(df, spark.createDataFrame([*used, (1, 2), (1, 2)], "track_id long, other_id long"), 7)
        pairs = df.alias("a").join(df.alias("b"), c("a.track_id") != c("b.track_id"))
        delta = keys.delta_percent(c("a.bpm"), c("b.bpm"))
        rel = keys.relation(c("a.key_camelot"), c("b.key_camelot"))
        every = pairs.select(c("a.track_id").alias("t"), c("b.track_id").alias("o"), keys.transition_score(rel, delta).alias("s"), delta.alias("d"), rel.alias("r")).where("r <> 'unknown'").collect()
        want, both = {}, used | {(1, 2)}
        for t in range(90):
            best = sorted((-r["s"], (t, r["o"]) in both, abs(r["d"]), r["o"]) for r in every if r["t"] == t)[:7]
            want |= {(t, k + 1): (o, -s, u) for k, (s, u, _, o) in enumerate(best)}
        assert {(r["track_id"], r["rank"]): (r["other_id"], r["score"], r["used"]) for r in got.collect()} == want


def test_nearest_by_relation_with_ties_and_unknown_tempos(spark):
    rows = [(i, "8A", 120.0) for i in range(12)] + [(20, "8A", None), (21, "8A", 119.0), (22, "9A", None), (23, "9A", 121.0), (24, "8B", 300.0), (25, "x", 120.0), (26, None, 1.0)]
    got = harmony.top_per_relation(spark.createDataFrame(rows, "track_id long, key_camelot string, bpm double"), 3)
    by = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        by.setdefault((r["track_id"], r["relation"]), []).append((r["other_id"], r["gap"]))
    assert by[0, "same"] == [(1, 0.0), (2, 0.0), (3, 0.0)] and by[1, "same"] == [(0, 0.0), (2, 0.0), (3, 0.0)]
    assert by[0, "plus_one"] == [(23, 1.0), (22, None)] and by[0, "mood_shift"] == [(24, 180.0)]
    assert by[20, "same"] == [(0, None), (1, None), (2, None)] and by[21, "same"][0] == (0, 1.0) and by[22, "minus_one"] == [(0, None), (1, None), (2, None)]
    assert not {25, 26} & {k[0] for k in by}


def test_fuzzy_match_is_lossless(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words = ["red", "blue", "sky", "sea", "sun", "moon", "live", "mix", "dub", "one"]
    name = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    lib = [(i, name(7) + ".mp3", name(7) or None, name(3) or None) for i in range(80)]
    lines = [(i, name(8) or None, name(3) or None) for i in range(80)] + [(90 + i, x[2], None) for i, x in enumerate(lib[:10])]
    tok = lambda s: set("".join(ch for ch in (s or "").lower() if ch.isalnum() or ch == " ").split())
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = {}
    for k, title, artist in lines:
        scored = [(-(0.6 * max(sim(tok(title), tok(t)), sim(tok(title), tok(f))) + 0.4 * sim(tok(artist), tok(a))), f, i) for i, f, t, a in lib]
        best = min((x for x in scored if -x[0] > 0.5), default=None)
        if best:
            want[k] = (best[2], round(-best[0], 9))
    monkeypatch.setattr(sets.join_cells, "__defaults__", (3,))  # most cells are split
    got = sets.match_setlist(spark.createDataFrame(lines, "id long, title string, artist string"), spark.createDataFrame(lib, "track_id long, filename string, title string, artist string"), ["id"])
    assert {r["id"]: (r["track_id"], round(r["similarity"], 9)) for r in got.collect()} == want and len(want) > 20


def test_vectors_of_the_beat_rules(spark):
    beats = spark.createDataFrame([(1, k, 10 * k) for k in range(5)], "track_id long, beat int, frame int")
    onset = spark.createDataFrame([(1, f, v) for f, v in {0: 0.5, 2: 0.5, 10: 0.2, 8: 0.9, 12: 0.9, 20: 0.0, 31: 0.1}.items()], "track_id long, frame int, onset double")
    # equal strengths do not move a beat, of two stronger ones the earlier wins
    assert {r["beat"]: r["frame"] for r in signal.snap(beats, onset).collect()} == {0: 0, 1: 8, 2: 20, 3: 31, 4: 40}
    for start, want in ((100.0, 0.7 * 6 * 16 + 30), (50.0, 50.0), (200.0, 200.0)):
        got = signal.interval_bpm(beats, spark.createDataFrame([(1, start)], "track_id long, bpm double"), rate=16.0).first()["bpm"]
        assert abs(got - want) < 1e-9
    rolled = signal.time_roll(spark.createDataFrame([(1, [[float(k)] for k in range(7)])], "track_id long, m array<array<double>>"), "m", 3).collect()
    assert len(rolled) == 4 and all([x[0] for x in r["m"]] == [float((k - r["shift"]) % 7) for k in range(7)] and -50 <= r["shift"] < 50 for r in rolled)


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(i, "a" if i < 900 else None if i < 950 else "b") for i in range(1000)], "id long, label string")
    got = evaluation.split(rows, "label", "id", 7, 5, ranges=8)
    counts = {(r["label"], r["fold"]): r["n"] for r in got.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", f): 180 for f in range(5)} | {(None, f): 10 for f in range(5)} | {("b", f): 10 for f in range(5)}


def test_greedy_paths_by_hand(spark):
    import random

    rng = random.Random(6)
    edges = [(a, b, rng.choice([70, 85, 95]), float(rng.choice([-3, 1, 2]))) for a in range(15) for b in rng.sample(range(15), 4) if a != b]
    got = {r["seed_id"]: r["path"] for r in harmony.paths(spark.createDataFrame(edges, "track_id long, other_id long, score int, delta_pct double"), spark.range(20).withColumnRenamed("id", "track_id"), 6).collect()}
    for seed in range(20):
        path = [seed]
        for _ in range(5):
            free = [(-s, abs(d), b) for a, b, s, d in edges if a == path[-1] and b not in path]
            path += [min(free)[2]] if free else []
            if not free:
                break
        assert got[seed] == path


def test_peaks_by_hand(spark):
    import random

    rng = random.Random(12)
    values = {k: rng.choice([-0.1, 0.1, 0.2, 0.3, 0.5, 0.9]) for k in range(64)}
    ac = spark.createDataFrame([(1, k, x) for k, x in values.items()], "track_id long, lag int, value double")
    found = []
    for k in range(4, 61):
        a, b, z = values[k - 1], values[k], values[k + 1]
        if b > 0 and a < b > z:
            bend = a - 2 * b + z
            found.append((k, b, k + 0.5 * (a - z) / bend if abs(bend) >= 1e-10 else float(k)))
    kept = []
    for peak in found:
        if kept and peak[0] - kept[-1][0] <= 3:
            if peak[1] > kept[-1][1]:
                kept[-1] = peak
        else:
            kept.append(peak)
    best = sorted(kept, key=lambda x: (-x[1], x[0]))[:5]
    got = signal.peaks(ac, 4, 60, top=5).orderBy("rank").collect()
    assert [(r["lag"], r["strength"], round(r["place"], 9)) for r in got] == [(k, b, round(p, 9)) for k, b, p in best]
