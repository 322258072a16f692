"""Nearest items in cells and playlists for seeds, against every pair by hand."""

import random

import pytest
from pyspark.sql.functions import col

from spinlattice.functions import keys
from spinlattice.operators import harmony, nearest


def lanes(rows, cell, x, m):
    own = [(i, y) for k, i, y in rows if k == cell]
    timed = [] if x is None else [r for r in own if r[1] is not None]
    up = sorted((y, i) for i, y in timed if y >= x)[:m]
    down = sorted((-y, i) for i, y in timed if y < x)[:m]
    blank = [] if x is None else sorted(i for i, y in own if y is None)[:m]
    return [i for _, i in up], [i for _, i in down], blank, sorted(i for i, _ in own)[:m]


@pytest.mark.parametrize("m", [1, 40])
def test_nearest(spark, monkeypatch, m):
    monkeypatch.setattr(nearest, "BLOCK", 8)
    rng = random.Random(m)
    x = lambda: rng.choice([None, 100.0, 100.0, 120.0, round(rng.uniform(50, 200), 1)])
    rows = [(rng.choice([1, 1, 1, 2, 5]), i, x()) for i in range(400)]
    wanted = {(k, x()) for k in (1, 2, 3, 5) for _ in range(30)}
    items = spark.createDataFrame(rows, "cell int, id long, x double").repartition(6)
    asked = spark.createDataFrame(list(wanted), "cell int, x double")
    for far in (m == 1,):
        got = nearest.nearest(items, asked, m, far).collect()
        assert len(got) == len(wanted)
        for r in got:
            want = lanes(rows, r["cell"], r["x"], m)
            have = [[e["id"] for e in r[lane] or []] for lane in ("up", "down", "blank", "every")]
            assert have[:3] == list(want[:3]) and have[3] == (want[3] if far or r["x"] is None else [])
    asks = [(n, k, x_, rng.choice([1, 2, 30, 500])) for n, (k, x_) in enumerate(wanted)]
    deep = nearest.nearest_deep(items, spark.createDataFrame(asks, "ask int, cell int, x double, depth int")).collect()
    for n, k, x_, depth in asks:
        want = lanes(rows, k, x_, depth)
        assert sorted(r["id"] for r in deep if r["ask"] == n) == sorted(sum(want[:3], []) if x_ is not None else want[3])


def test_no_items(spark):
    nothing, asked = spark.createDataFrame([], "cell int, id long, x double"), spark.createDataFrame([(1, 2.0), (2, None)], "cell int, x double")
    assert [r["up"] for r in nearest.nearest(nothing, asked, 3).collect()] == [None, None] and nearest.nearest(nothing, asked.limit(0), 3).count() == 0


def total(a, b, score):
    bpm = a[2] if a[2] is not None else 128.0
    gap = min(abs((b[2] if b[2] is not None else bpm) - bpm), 20.0)
    return score * 0.7 + (1 - gap / 20) * 0.3


@pytest.mark.parametrize("codes", [["8A", "9A", None], ["8A", "8a", "All", "", "3B"], [f"{n}{x}" for n in range(1, 13) for x in "AB"]])
def test_playlists(spark, codes):
    rng = random.Random(len(codes))
    for spread in (30, 400):
        rows = [(i, rng.choice(codes), None if rng.random() < 0.1 else round(rng.uniform(100 - spread / 2, 100 + spread / 2), 1)) for i in range(120)]
        library = spark.createDataFrame(rows, "track_id long, key_camelot string, bpm double").repartition(4)
        seeds = library.where("track_id % 4 = 0")
        pairs = library.selectExpr("key_camelot a").distinct().crossJoin(library.selectExpr("key_camelot b").distinct())
        rules = keys.Rules(minus_two=False, plus_two=False)
        scores = {(r["a"], r["b"]): r["s"] or 0.0 for r in pairs.select("a", "b", keys.compatibility(pairs["a"], pairs["b"], rules).alias("s")).collect()}
        for n in (3, 90) if spread == 30 else (10,):
            got = sorted((r["seed_id"], r["place"], r["track_id"]) for r in harmony.generate_playlist(library, seeds, n, rules).collect())
            want = []
            for a in (r for r in rows if r[0] % 4 == 0):
                ranked = sorted((-round(t, 9), b[0]) for b in rows if b[0] != a[0] and (t := total(a, b, scores[a[1], b[1]] if a[1] and b[1] else (scores[a[1], b[1]] if a[1] == b[1] and a[1] is not None else 0.0))) > 0)
                want += [(a[0], 0, a[0])] + [(a[0], k + 1, i) for k, (_, i) in enumerate(ranked[: n - 1])]
            assert got == sorted(want), n
        for same in (True, False) if spread == 30 else ():
            got = sorted((r["seed_id"], r["place"], r["track_id"]) for r in harmony.same_key_playlist(library, seeds, same, 7).collect())
            want = []
            for a in (r for r in rows if r[0] % 4 == 0):
                gap = lambda b, a=a: abs(b[2] - a[2]) if a[2] is not None and b[2] is not None else float("inf")
                ranked = sorted((gap(b), b[0]) for b in rows if b[0] != a[0] and (not same or (a[1] is not None and a[1] == b[1])))
                want += [(a[0], k + 1, i) for k, (_, i) in enumerate(ranked[:6])]
            assert got == sorted(want)


def test_greedy_paths(spark):
    rng = random.Random(6)
    edges = {(a, b): (rng.choice([50, 80, 80, 100]), rng.choice([-2.0, -1.0, 0.0, 1.0, 3.0])) for a in range(40) for b in rng.sample(range(40), 6) if a != b and a != 39}
    df = spark.createDataFrame([(a, b, s, d) for (a, b), (s, d) in edges.items()], "track_id long, other_id long, score int, delta_pct double")
    got = {r["seed_id"]: r["path"] for r in harmony.paths(df, spark.range(41).withColumnRenamed("id", "track_id"), 9).collect()}
    for seed in range(41):
        path = [seed]
        while len(path) < 9:
            free = [(-s, abs(d), b) for (a, b), (s, d) in edges.items() if a == path[-1] and b not in path]
            if not free:
                break
            path.append(min(free)[2])
        assert got[seed] == path


def test_candidates_are_ranked_in_tasks_by_tracks(spark, monkeypatch):
    from spinlattice.operators import harmony

    tracks = spark.createDataFrame([(i, f"{i % 12 + 1}{'AB'[i % 2]}", 90.0 + i % 37) for i in range(300)], "track_id long, key_camelot string, bpm double")
    whole = harmony.next_candidates(tracks, n=5)
    monkeypatch.setattr(harmony, "TRACKS_A_TASK", 50)
    dealt = harmony.next_candidates(tracks, n=5)
    assert dealt.rdd.getNumPartitions() == 6  # however few bytes the rows have before they unfold
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 1500


def test_candidates_with_used_partners_deal_a_row_a_track(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"{rng.randint(1, 12)}{rng.choice('AB')}", rng.choice([None, 120.0, 120.0, round(rng.uniform(80, 160), 1)])) for i in range(250)]
    tracks = spark.createDataFrame(rows, "track_id long, key_camelot string, bpm double")
    # near partners and far ones; track 3 has used most others, itself and one that the library lacks
    pairs = [(i, rng.randrange(250)) for i in range(200) for _ in range(rng.choice([0, 1, 6]))] + [(3, i) for i in range(200)] + [(3, 999)]
    used = spark.createDataFrame([*pairs, *pairs[:50]], "track_id long, other_id long")
    light = used.where("track_id <> 3")
    plan = harmony.next_candidates(tracks, light, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(track_id" not in plan  # candidates are not dealt by track to be ranked
    got = []
    for spare in (24, 2, 1000):
        monkeypatch.setattr(harmony, "SPARE", spare, raising=False)
        got.append(sorted(map(tuple, harmony.next_candidates(tracks, used, 5).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 1250
    score = {(r["a"], r["b"]): r["r"] for r in spark.sql("SELECT 1").crossJoin(tracks.selectExpr("key_camelot a").distinct()).crossJoin(tracks.selectExpr("key_camelot b").distinct()).select("a", "b", keys.relation(col("a"), col("b")).alias("r")).collect()}
    base = {"same-key": 95, "neighbor": 85, "mood-shift": 80, "energy-boost": 75, "energy-drop": 70, "tension": 40, "bridge-needed": 20}
    taken, by_hand = set(pairs), set()
    for a in rows:
        delta = lambda b, a=a: (b[2] - a[2]) / a[2] * 100 if a[2] and b[2] is not None else 0.0
        points = lambda b, a=a, delta=delta: max(0, base[score[a[1], b[1]]] - (min(20, int((abs(delta(b)) - 6) * 2 + 0.5)) if abs(delta(b)) > 6 else 0))
        best = sorted((-points(b), (a[0], b[0]) in taken, abs(delta(b)), b[0]) for b in rows if b[0] != a[0])[:5]
        by_hand |= {(a[0], o, -s, u, k + 1) for k, (s, u, _, o) in enumerate(best)}
    assert {(r[0], r[1], r[4], r[5], r[6]) for r in got[0]} == by_hand
