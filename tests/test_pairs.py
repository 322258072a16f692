"""What a pair costs: nothing of a track is parsed or looked up where pairs meet."""

from spinlattice.operators import harmony

SCHEMA = "track_id long, key_camelot string, bpm double"
ROWS = [(1, "8A", 120.0), (2, " 08a", 121.0), (3, "9A", None), (4, None, 119.0), (5, "none", 126.9), (6, "8B", 113.0), (7, "none", 0.0)]


def above_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join ")]


def test_seed_scores_parse_no_pairs(spark):
    from pyspark.sql import functions as F

    from spinlattice.functions import keys

    t = spark.createDataFrame(ROWS, SCHEMA)
    got = harmony.score_seed(t, t)
    assert "regexp_extract" not in above_join(got)
    # the same weights as from the texts of each pair
    again = F.coalesce(keys.compatibility(F.col("seed_key"), F.coalesce("key_camelot", F.lit(""))), F.lit(0.0))
    assert got.where(F.col("compat") != again).count() == 0 and got.count() == 42


def test_pairs_are_dealt_to_tasks_by_pairs(spark, monkeypatch, capsys):
    t = spark.createDataFrame([(i, f"{i % 12 + 1}A", 120.0) for i in range(240)], SCHEMA)
    monkeypatch.setattr(harmony, "PAIRS_A_TASK", 100, raising=False)
    # 24 codes by the matrix: each of 20 tracks a code meets those of five codes, itself among them
    for got, tasks, rows in ((harmony.compatible_tracks(t, t), 240, 240 * 99), (harmony.score_seed(t, t), 576, 240 * 239)):
        got.explain()
        assert capsys.readouterr().out.count(f", {tasks}), REPARTITION_BY_NUM") == 2
        assert got.count() == rows
    got = harmony.compatible_tracks(t, t)
    assert above_join(got) and "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_no_pairs(spark):
    t = spark.createDataFrame(ROWS, SCHEMA)
    assert harmony.compatible_tracks(t, t.limit(0)).count() == 0 and harmony.score_seed(t.limit(0), t).count() == 0


def test_neighbours_look_up_no_pairs(spark):
    t = spark.createDataFrame(ROWS + [(100 + i, "8A", 60 + i / 4) for i in range(400)], SCHEMA)
    got = harmony.neighbours(t)
    assert "neighbor" not in above_join(got)
    bpm = {r["track_id"]: r["bpm"] for r in t.collect() if r["key_camelot"] in ("8A", " 08a") and r["bpm"]}
    want = {(a, b) for a in bpm for b in bpm if a != b and abs(bpm[b] - bpm[a]) / bpm[a] <= 0.06}
    rows = got.where("relation = 'same-key'").collect()
    assert {(r["track_id"], r["other_id"]) for r in rows} == want and {r["score"] for r in rows} == {95}


def test_setlist_lines_meet_few_tracks(spark):
    from pyspark.sql import functions as F

    from spinlattice.operators import sets

    # one artist and two words shared by all: a line with a track of its own meets that one, not the whole library
    lib = spark.range(600).select(F.col("id").alias("track_id"), F.lit("large ring").alias("title"), F.lit("Unknown Artist").alias("artist"), F.concat(F.lit("large ring "), "id", F.lit(".mp3")).alias("filename"))
    lines = lib.where("track_id < 50").select("track_id", F.concat(F.upper("filename"), F.lit(" (Live!)")).alias("title"), "artist")
    pairs = sets.setlist_pairs(lines.select(F.col("title").alias("_t"), F.col("artist").alias("_a")), lib)
    assert pairs.count() <= 4 * 50
    got = sets.match_setlist(lines.withColumnRenamed("track_id", "line"), lib, ["line"]).collect()
    assert len(got) == 50 and all(r["track_id"] == r["line"] for r in got)
    # a line without a rare token still meets all of them: the first by file name of equal ones
    one = sets.match_setlist(spark.createDataFrame([(1, "Large Ring", "Unknown Artist")], "line int, title string, artist string"), lib, ["line"]).collect()
    assert [(r["track_id"], r["similarity"]) for r in one] == [(0, 1.0)]


def test_code_pairs_are_looked_up(spark):
    from pyspark.sql import functions as F

    from spinlattice.functions import keys, text

    texts = ["8A", " 08b ", "9a", "12B", "1B", "x", "", None, "13A"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "ak string, bk string")
    rules = {"ok": (keys.is_compatible, False), "strength": (keys.strength, 0), "relation": (keys.relation, "unknown"), "verdict": (text.harmonic_verdict, "warn")}
    got = keys.by_codes(rows, "ak", "bk", rules)
    assert got.columns == ["ak", "bk", *rules] and got.count() == len(texts) ** 2
    for name, (rule, _) in rules.items():
        assert got.where(~F.col(name).eqNullSafe(rule(F.col("ak"), F.col("bk")))).count() == 0, name


def test_ambiguity_is_a_small_tree(spark):
    from pyspark.sql import functions as F

    from spinlattice.functions import keys

    names = keys.dim_key(spark).select("name")
    df = names.crossJoin(names.withColumnRenamed("name", "other")).select(keys.ambiguity(F.col("name"), F.col("other")).alias("kind"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 40_000
    assert {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()} == {"same": 24, "parallel": 24, "relative": 24, "close_wheel": 48, "distant": 456}


def test_pairs_of_one_key_are_many_tasks(spark, monkeypatch):
    """All tracks have one code and tempo: a task makes its share of the pairs, however many parts a key needs."""
    t = spark.createDataFrame([(i, "8A", 120.0) for i in range(600)], SCHEMA)
    monkeypatch.setattr(harmony, "PAIRS_A_TASK", 3600, raising=False)
    for got in (harmony.neighbours(t), harmony.compatible_tracks(t, t), harmony.score_seed(t, t)):
        sizes = [n for n in got.select("track_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(sizes) == 600 * 599 and max(sizes) < 12 * 3600 and len(sizes) > 40


def test_pairs_round_as_the_second_engine(spark):
    import duckdb
    from pyspark.sql import functions as F

    from spinlattice.queries.registry import p6

    values = [0.0, 1e-7, -1e-7, 0.1234565, -0.1234565, 2.5000005, -5.9999995, 6.0, -6.0, 0.7, 1 / 3, -2 / 3, None]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(p6(F.col("v")).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
