"""Blocks of long series against whole series in numpy."""

import random

import numpy as np
import pytest

from spinlattice.operators import blocks, signal


def medians(x, radius):
    """Along the first axis, over the values that are there."""
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        if not np.isnan(x[i]):
            near = x[(slice(max(0, i[0] - radius), i[0] + radius + 1), *i[1:])]
            near = np.sort(near[~np.isnan(near)])
            out[i] = near[len(near) // 2]
    return out


@pytest.mark.parametrize(("n", "radius"), [(1, 8), (5, 8), (40, 3), (200, 8)])
def test_running_median(n, radius):
    rng = np.random.default_rng(n)
    x = rng.choice([0.0, 1.0, 2.5, rng.random()], (n, 7)) + rng.choice([0, 1e-3], (n, 7))
    for holes in (0.0, 0.3):
        y = np.where(rng.random(x.shape) < holes, np.nan, x)
        assert np.array_equal(blocks.running_upper_median(y, radius), medians(y, radius), equal_nan=True)


def frame_of(spark, tracks):
    rows = [(t, f, b, float(x[f, b])) for t, x in tracks.items() for f, b in np.argwhere(~np.isnan(x)).tolist()]
    return spark.createDataFrame(rows, "track_id long, frame int, bin int, mag double").repartition(5)


def test_split_and_flux(spark):
    rng = np.random.default_rng(1)
    tracks = {1: rng.random((1300, 20)), 2: rng.random((3, 20)), 3: rng.random((512, 20)), 4: np.where(rng.random((600, 20)) < 0.2, np.nan, rng.random((600, 20)))}
    spec = frame_of(spark, tracks)
    got = {(r["track_id"], r["frame"], r["bin"]): (r["harmonic"], r["percussive"]) for r in blocks.harmonic_split(spec).collect()}
    assert len(got) == spec.count()
    for t, x in tracks.items():
        h, p = medians(x, 8), medians(x.T, 8).T
        mask = h * h / (h * h + p * p + 1e-10)
        for f, b in np.argwhere(~np.isnan(x)).tolist():
            assert got[t, f, b] == pytest.approx((x[f, b] * mask[f, b], x[f, b] * (1 - mask[f, b])))
    full = {t: x for t, x in tracks.items() if t != 4}
    flux = {(r["track_id"], r["frame"]): r["onset"] for r in signal.spectral_flux(frame_of(spark, full), [4, 11]).collect()}
    for t, x in full.items():
        rise = np.vstack([np.zeros((1, 20)), np.maximum(np.diff(x, axis=0), 0)])
        bands = np.stack([rise[:, a:z].sum(axis=1) for a, z in ((0, 4), (4, 11), (11, 20))])
        total = (bands / np.maximum(bands.max(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        total = total / total.max()
        for f in range(len(x)):
            assert flux[t, f] == pytest.approx(total[max(0, f - 3) : f + 4].mean())


def test_a_long_track(spark):
    """100,000 frames of one track: medians, lags and the self-join form; one shuffle of the rows."""
    n = 100_000
    series = spark.range(n).selectExpr("1L as track_id", "cast(id as int) as frame", "cast(pmod(xxhash64(id), 997) as double) / 997 as onset").repartition(7)
    x = np.array([r["onset"] for r in series.orderBy("frame").collect()])
    med = blocks.sliding_upper_median(series, "onset")
    assert med._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = np.array([r["med"] for r in med.orderBy("frame").collect()])
    inner = np.sort(np.lib.stride_tricks.sliding_window_view(x, 17), axis=1)[:, 8]
    assert len(got) == n and np.array_equal(got[8:-8], inner) and np.array_equal(got[:8], medians(x[:16, None], 8)[:8, 0])
    auto = {r["lag"]: r["value"] for r in signal.autocorrelation(series, 50).collect()}
    join = {r["lag"]: r["value"] for r in signal.autocorrelation_by_join(series, 50).collect()}
    assert auto.keys() == join.keys() and all(auto[k] == pytest.approx(join[k], abs=1e-9) for k in join)


def test_lags_of_short_and_sparse_series(spark):
    rows = [(1, 0, 2.0), (1, 5, 3.0), (2, 0, 0.0), (2, 1, 0.0), (3, 9000, 1.0), (3, 8998, 1.0), (4, 0, 1.0)]
    got = {}
    for r in signal.autocorrelation(spark.createDataFrame(rows, "track_id long, frame int, onset double"), 8).collect():
        got.setdefault(r["track_id"], {})[r["lag"]] = round(r["value"], 9)
    assert got[1] == {k: {0: 1.0, 5: round(6 / 13, 9)}.get(k, 0.0) for k in range(6)} and got[2] == {0: 0.0, 1: 0.0} and got[4] == {0: 1.0}
    assert got[3] == {k: {0: 1.0, 2: 0.5}.get(k, 0.0) for k in range(9)}


def test_peaks_and_tempo(spark):
    """Local maxima, merging, places and tempos of random correlations, step by step."""
    rng = np.random.default_rng(12)
    series = {t: np.round(rng.random(120) * (rng.random(120) > 0.3), 2) for t in range(25)} | {25: np.zeros(120), 26: np.linspace(1, 0, 120)}
    ac = spark.createDataFrame([(t, k, float(v)) for t, x in series.items() for k, v in enumerate(x)], "track_id long, lag int, value double").repartition(4)
    low, high, top, apart = 12, 100, 10, 3
    got, tempos, want_tempos = {}, {}, {}
    for r in signal.peaks(ac, low, high, top, apart).collect():
        got.setdefault(r["track_id"], {})[r["rank"]] = (r["lag"], r["strength"], round(r["place"], 9))
    for t, x in series.items():
        # neighbours outside the range of lags do not count, as in a search that looks at the range alone
        inside = {k: x[k] for k in range(low, high + 1) if x[k] > 0}
        kept = []
        for k, v in inside.items():
            if (k == 0 or x[k - 1] < v) and (k + 1 >= len(x) or x[k + 1] < v):
                if kept and k - kept[-1][0] <= apart:
                    if v > kept[-1][1]:
                        kept[-1] = (k, v)
                else:
                    kept.append((k, v))
        ranked = sorted(kept, key=lambda p: (-p[1], p[0]))[:top]
        place = lambda k, x=x: k + 0.5 * (x[k - 1] - x[k + 1]) / (x[k - 1] - 2 * x[k] + x[k + 1]) if abs(x[k - 1] - 2 * x[k] + x[k + 1]) >= 1e-10 else float(k)
        want = {i + 1: (k, v, round(place(k), 9)) for i, (k, v) in enumerate(ranked)}
        assert got.get(t, {}) == want, t
        rate = signal.FRAME_RATE
        each = [(v * np.exp(-0.5 * np.log2(bpm / 120) ** 2), bpm) for k, v in ranked for m in (0.5, 1, 2) if 40 <= (bpm := 60 * rate / place(k) * m) <= 220]
        each.sort(key=lambda s: (-s[0], s[1]))
        want_tempos[t] = (each[0][1], max(0.0, min(1.0, 1 - (each[1][0] if len(each) > 1 else 0) / each[0][0]))) if each else (120.0, 0.0)
    peaks = signal.peaks(ac, low, high, top, apart)
    for r in signal.tempo(peaks, ac.select("track_id").distinct()).collect():
        tempos[r["track_id"]] = (r["bpm"], r["confidence"])
    assert tempos.keys() == want_tempos.keys() and all(tempos[t] == pytest.approx(want_tempos[t]) for t in tempos)


def test_lags_meet_in_blocks_not_once_a_lag(spark, capsys):
    rng = random.Random(5)
    value = {(t, f): rng.random() for t in (1, 2) for f in rng.sample(range(-20, 200), 90)}
    onset = spark.createDataFrame([(t, f, x) for (t, f), x in value.items()], "track_id long, frame int, onset double")
    got = signal.autocorrelation_by_join(onset, 13)
    got.explain()
    assert "sequence(" not in capsys.readouterr().out  # a row a lag
    raw = {}
    for (t, f), x in value.items():
        for lag in range(14):
            if (t, f + lag) in value:
                raw[t, lag] = raw.get((t, lag), 0) + x * value[t, f + lag]
    held = {(r["track_id"], r["lag"]): r["value"] for r in got.collect()}
    assert set(held) == set(raw) and all(abs(held[k] - raw[k] / raw[k[0], 0]) < 1e-9 for k in raw)
