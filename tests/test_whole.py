"""Queries hold every row of the tables, against versions by hand on the smallest tables."""

import math
import os
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(spark, name):
    from spinlattice.catalog_queries import QUERIES

    return QUERIES[name](spark, SF).collect()


def table(spark, name):
    from spinlattice.plans.views import view

    return view(spark, SF, name).collect()


def test_beats_of_all_tracks(spark):
    active, tempos = {}, defaultdict(dict)
    for g in sorted(table(spark, "v_beat_grids"), key=lambda g: g["source"], reverse=True):
        at = (g["is_override"], g["created_at"])
        if g["track_id"] not in active or at >= active[g["track_id"]][0]:
            active[g["track_id"]] = (at, g)
        start = g["first_beat_ms"] * 40.0
        tempos[g["track_id"]][start] = max(tempos[g["track_id"]].get(start, 0), g["bpm"])
    beats, force = {}, {}
    for t, (_, g) in active.items():
        step = 60000.0 / g["bpm"]
        for b in range(math.floor((60000 - g["first_beat_ms"]) / step) + 1):
            ms, at = g["first_beat_ms"] + b * step, b - g["downbeat_offset_beats"]
            beats[t, b] = (ms, g["source"], at // g["meter_numerator"], at % g["meter_numerator"], at % g["meter_numerator"] == 0)
            held = [x for x in tempos[t].items() if x[0] <= ms]
            force[t, b] = round(max(held)[1], 4) if held else None
    got = {(r["track_id"], r["beat"]): (r["ms"], r["source"], r["bar"], r["beat_in_bar"], r["is_downbeat"]) for r in rows(spark, "i24_beat_grid")}
    assert {k: x[1:] for k, x in got.items()} == {k: x[1:] for k, x in beats.items()}
    assert all(abs(x[0] - beats[k][0]) < 1e-5 for k, x in got.items())
    assert len({t for t, _ in got}) == len(active) > 20 * len({t for t, _ in got if t % 20 == 0}) * 0.9
    got = {(r["track_id"], r["beat"]): r["bpm"] and round(r["bpm"], 4) for r in rows(spark, "d13_tempo_in_force")}
    assert got == force


def test_lines_of_all_playlists(spark):
    every = {(r["playlist_id"], r["position"]) for r in table(spark, "v_playlist_tracks")}
    for name in ("f02_setlist_flow", "h08_token_sets"):
        got = [(r["set_id"], r["position"]) for r in rows(spark, name)]
        assert set(got) == every and len(got) == len(every)
    assert {r["set_id"]: r["total"] for r in rows(spark, "e15_setlist_summary")} == Counter(p for p, _ in every)


def test_seeds_of_the_stated_set(spark):
    tracks = {r["track_id"]: r["key_camelot"] for r in table(spark, "v_tracks")}
    asked = {t for t in tracks if t % 50 == 0}
    for name in ("d04_seed_scores", "g02_generate_playlist"):
        assert {r["seed_id"] for r in rows(spark, name)} == asked
    keyed = {t for t in asked if tracks[t]}
    for name in ("b08_compatible_tracks", "g05_same_key_playlist"):
        assert {r["seed_id"] for r in rows(spark, name)} == keyed
    assert len(rows(spark, "d04_seed_scores")) == len(asked) * (len(tracks) - 1)
    counted = Counter()
    for r in rows(spark, "e20_relation_counts"):
        counted[r["seed_id"]] += r["n"]
    assert counted == dict.fromkeys(tracks, len(tracks) - 1)
    assert {r["seed_id"] for r in rows(spark, "l04_greedy_paths")} == set(tracks)


def test_joins_with_seeds_broadcast_no_seeds(spark, capsys):
    from spinlattice.catalog_queries import QUERIES

    for name in ("d04_seed_scores", "g05_same_key_playlist"):
        QUERIES[name](spark, SF).explain()
        assert "BroadcastNestedLoopJoin" not in (plan := capsys.readouterr().out) and "SortMergeJoin" in plan


def test_templates_are_applied_to_every_segment(spark):
    got = [(r["track_id"], r["segment"], r["family"], r["mode"], r["tonic"]) for r in rows(spark, "i10_templates")]
    assert set(got) == {(r["track_id"], r["segment"], r["family"], r["mode"], r["tonic"]) for r in rows(spark, "i11_template_scores")}
    assert len(got) == len(set(got)) and len({x[:2] for x in got}) > 1
