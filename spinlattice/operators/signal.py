"""Time-series operators over frame tables, a track's frames spread over the cluster as rows.

onset (track_id, frame, onset), chroma (track_id, frame, c12, c72), spectrogram (track_id, frame, bin, mag),
pcm (track_id, frame, samples). Arrays are one frame's bins or one track's profile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.scoring import tempo_preference, upper_median
from ..shared import materialize
from .blocks import band_flux, haloed, harmonic_split, lag_products, own, sliding_upper_median  # noqa: F401

c = F.col
# fixed values: key profiles, major and minor (and amodal)
PROFILES = {
    "krumhansl": ([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88], [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
    "temperley": ([0.26, 0.04, 0.11, 0.06, 0.16, 0.14, 0.06, 0.18, 0.05, 0.12, 0.05, 0.08], [0.26, 0.07, 0.12, 0.18, 0.07, 0.12, 0.07, 0.16, 0.14, 0.08, 0.10, 0.09]),
    "shaath": ([7.239005026181452, 3.503511667251587, 3.584451775366494, 2.845118164786763, 5.818988921185498, 4.558650574153210, 2.447788505455065, 6.994731921468295, 3.391066136735049, 4.556142566551435, 4.073926666635236, 4.459327573788869],
               [7.002550450602844, 3.143602790159967, 4.359043197149625, 5.404181207189341, 3.672344208793061, 4.089711849177979, 3.907914359915540, 6.199602885623165, 3.634246256252774, 2.872411910798756, 5.354679997945427, 3.832420385950484]),
    "braw": ([1.0000, 0.1573, 0.4200, 0.1570, 0.5296, 0.3669, 0.1632, 0.7711, 0.1676, 0.3827, 0.2113, 0.2965], [1.0000, 0.2330, 0.3615, 0.3905, 0.2925, 0.3777, 0.1961, 0.7425, 0.2701, 0.2161, 0.4228, 0.2272], [1.0000, 0.2608, 0.3528, 0.2935, 0.4393, 0.3580, 0.2137, 0.7809, 0.2578, 0.2539, 0.3233, 0.2615]),
    "bgate": ([1.00, 0.00, 0.42, 0.00, 0.53, 0.37, 0.00, 0.77, 0.00, 0.38, 0.21, 0.30], [1.00, 0.00, 0.36, 0.39, 0.00, 0.38, 0.00, 0.74, 0.27, 0.00, 0.42, 0.23], [1.00, 0.26, 0.35, 0.29, 0.44, 0.36, 0.21, 0.78, 0.26, 0.25, 0.32, 0.26]),
}
OCTAVES = [0.3999726755, 0.556344252483, 0.524966363451, 0.608475483843, 0.5989811568, 0.49072435318]
WEIGHTS = {"krumhansl": 0.15, "temperley": 0.25, "shaath": 1.0}
FRAME_RATE = 22050 / 512
BY = ["track_id"]
#: Frames of a block where a row a frame is averaged.
SMOOTH = 1 << 16


def _over(*order: str) -> Window:
    return Window.partitionBy(*BY).orderBy(*(order or ("frame",)))


def centred_window(frames: DataFrame, length: int) -> DataFrame:
    """The middle ``length`` frames of each track, all if it has fewer."""
    top = F.max("frame").over(Window.partitionBy(*BY)) + 1
    start = F.greatest(F.lit(0), F.floor((top - length) / 2))
    return frames.withColumn("_s", start).where((c("frame") >= c("_s")) & (c("frame") < c("_s") + length)).drop("_s")


def framing(signal: DataFrame, size: int, hop: int) -> DataFrame:
    """(track_id, samples) to overlapping frames of ``size`` every ``hop``; an incomplete last frame is left out."""
    n = F.floor((F.size("samples") - size) / hop)
    return signal.where(F.size("samples") >= size).select("track_id", "samples", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("frame")).select("track_id", "frame", F.slice("samples", c("frame") * hop + 1, F.lit(size)).alias("samples"))


def spectrum(frames: DataFrame) -> DataFrame:
    """Hann-windowed magnitude spectra of (track_id, frame, samples); the one kernel that needs Python."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for n, part in pdf.groupby(pdf["samples"].map(len)):
                w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
                mags = np.abs(np.fft.rfft(np.stack(part["samples"].to_list()) * w, axis=1))
                out.append(pd.DataFrame({"track_id": part["track_id"], "frame": part["frame"], "mags": list(mags)}))
            if out:
                yield pd.concat(out)

    return frames.select("track_id", "frame", "samples").mapInPandas(run, "track_id long, frame int, mags array<double>")


def bin_map(spark: SparkSession, bins: int, fft: int, rate: float, harmonics: bool = False) -> DataFrame:
    """Which pitch class a bin counts for, with weights; a broadcast dimension of a few rows a bin."""
    rows = []
    for b in range(1, bins):
        f = b * rate / fft
        for k, w in enumerate((1.0, 1 / 2, 1 / 3, 1 / 4), 1) if harmonics else ((1, 1.0),):
            if not harmonics or f > 200:
                rows.append((b, int(math.floor(12 * math.log2(f / k / 440) + 69 + 0.5)) % 12, w))
    return spark.createDataFrame(rows, "bin int, pc int, w double")


def fold(spec: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bins through a sparse map (bin, pc, w) to weighted sums; the map is broadcast, sums combine before the shuffle."""
    return spec.join(F.broadcast(mapping), "bin").groupBy("track_id", "frame", "pc").agg(F.sum(c("mag") * c("w")).alias("value"))


def kernel_map(spark: SparkSession, bins: int, fft: int, rate: float, stretch: float = 0.8, lowest: float = 32.70319566257483) -> DataFrame:
    """Sparse raised-cosine kernels of 72 semitone bands (pc is the band), each summing to its centre frequency's share."""
    q, rows = stretch * (2 ** (1 / 12) - 1), []
    for band in range(72):
        f = lowest * 2 ** (band / 12)
        centre = f * fft / rate
        width, begin = centre * q, centre - centre * q / 2
        part = [(b, 1 - math.cos(2 * math.pi * (b - begin) / width)) for b in range(math.ceil(begin), math.floor(begin + width) + 1) if 0 <= b < bins]
        total = sum(x for _, x in part)
        rows += [(b, band, x / total * f) for b, x in part if total > 0]
    return spark.createDataFrame(rows, "bin int, pc int, w double")


def chroma_of_bins(spec: DataFrame, bins: int) -> DataFrame:
    """track_id, frame, c12 and c72 of (track_id, frame, bin, mag) whose bins are bands already: the first 12, and 72 that go round the ``bins``."""
    each = spec.groupBy("track_id", "frame").agg(*(F.sum(F.when(c("bin") == b, c("mag"))).alias(f"_{b}") for b in range(bins)))
    at = lambda n: F.array(*(F.coalesce(c(f"_{b % bins}"), F.lit(0.0)) for b in range(n)))
    return each.select("track_id", "frame", at(12).alias("c12"), at(72).alias("c72"))


def mean_arrays(df: DataFrame, by: list[str], array: str, n: int) -> DataFrame:
    """Mean array of each group: one average a place, so partial sums combine before the shuffle."""
    return df.groupBy(*by).agg(*(F.avg(F.get(array, F.lit(i))).alias(f"_{i}") for i in range(n))).select(*by, F.array(*(c(f"_{i}") for i in range(n))).alias(array))


def mean_chroma(chroma: DataFrame) -> DataFrame:
    """I8: a track's mean chroma over its largest value."""
    got = mean_arrays(chroma, BY, "c12", 12)
    top = F.array_max("c12")
    return got.withColumn("c12", F.when(top > 0, F.transform("c12", lambda x: x / top)).otherwise(c("c12")))


def segment_means(chroma: DataFrame, segments: int = 16, array: str = "c12", n: int = 12) -> DataFrame:
    """L2-normalized means of equal segments; the last takes the remainder."""
    total = F.count("*").over(Window.partitionBy(*BY))
    at = F.row_number().over(_over()) - 1
    length = F.floor(total / segments)
    seg = F.when(length == 0, segments - 1).otherwise(F.least(F.floor(at / F.greatest(length, F.lit(1))), F.lit(segments - 1))).cast("int")
    got = mean_arrays(chroma.withColumn("segment", seg), [*BY, "segment"], array, n)
    norm = F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + x * x))
    return got.withColumn(array, F.when(norm > 0, F.transform(array, lambda x: x / norm)).otherwise(c(array)))


def templates(spark: SparkSession, families: list[str] | None = None, bands: int = 12) -> DataFrame:
    """(family, mode, tonic, vec): profiles rotated to each tonic, over one octave or, by octave weights, over six."""
    rows = []
    for family in families or [*WEIGHTS]:
        for mode, profile in zip(("major", "minor", "other"), PROFILES[family], strict=False):
            for tonic in range(12):
                turned = [profile[(i - tonic) % 12] for i in range(12)]
                rows.append((family, mode, tonic, turned if bands == 12 else [w * x for w in OCTAVES for x in turned]))
    return spark.createDataFrame(rows, "family string, mode string, tonic int, vec array<double>")


def template_scores(means: DataFrame, bank: DataFrame, array: str = "c12", gain: float = 5.0) -> DataFrame:
    """Log-compressed cosine of every mean with every template (a bank of under 200 rows, broadcast)."""
    squeezed = F.transform(array, lambda x: F.log1p(gain * F.abs(x)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = means.withColumn("_v", squeezed).withColumn("_n", F.sqrt(dot("_v", "_v"))).crossJoin(F.broadcast(bank.withColumn("_m", F.sqrt(dot("vec", "vec")))))
    return both.select(*[x for x in means.columns if x != array], "family", "mode", "tonic", F.when((c("_n") > 0) & (c("_m") > 0), dot("_v", "vec") / (c("_n") * c("_m"))).otherwise(0.0).alias("score"))


def ensemble(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the families."""
    w = F.element_at(F.create_map(*(F.lit(x) for p in (weights or WEIGHTS).items() for x in p)), c("family"))
    keep = [x for x in scores.columns if x not in ("family", "score")]
    return scores.groupBy(*keep).agg((F.sum(w * c("score")) / F.sum(w)).alias("score"))


def dual_scores(chroma: DataFrame, segments: int = 8, weights: dict[str, float] | None = None) -> DataFrame:
    """I11, I12 as an analysis uses them: segment scores of 24 keys, krumhansl and temperley on the 12 pitch classes, shaath on the 72 bands."""
    spark = chroma.sparkSession
    by12 = template_scores(segment_means(chroma, segments), templates(spark, ["krumhansl", "temperley"]))
    by72 = template_scores(segment_means(chroma, segments, "c72", 72), templates(spark, ["shaath"], 72), "c72", 3.0)
    return ensemble(by12.unionByName(by72), weights)


def soft_vote(scores: DataFrame) -> DataFrame:
    """Min-max in each segment, summed over segments; confidence is the share of a track's total; 24 ranked keys."""
    seg = Window.partitionBy(*BY, "segment")
    span = F.greatest(F.max("score").over(seg) - F.min("score").over(seg), F.lit(1e-10))
    total = scores.withColumn("x", (c("score") - F.min("score").over(seg)) / span).groupBy(*BY, "mode", "tonic").agg(F.sum("x").alias("total"))
    share = total.withColumn("confidence", F.try_divide("total", F.sum("total").over(Window.partitionBy(*BY))))
    rank = Window.partitionBy(*BY).orderBy(F.round("total", 9).desc(), "mode", "tonic")
    return share.withColumn("rank", F.row_number().over(rank))


def segment_winners(scores: DataFrame) -> DataFrame:
    """The best key of each segment; major before minor, lower tonics first among equals."""
    w = Window.partitionBy(*BY, "segment").orderBy(F.round("score", 9).desc(), "mode", "tonic")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def hard_vote(scores: DataFrame) -> DataFrame:
    """Keys ranked by confidence (.6 agreement + .4 mean score, cut to 0 and 1), then the segments they win, then the mean score."""
    won = segment_winners(scores).groupBy(*BY, "mode", "tonic").agg(F.count("*").alias("wins"), F.avg("score").alias("score"))
    agree = c("wins") / F.sum("wins").over(Window.partitionBy(*BY))
    got = won.withColumn("agreement", agree).withColumn("confidence", c("agreement") * 0.6 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("score"))) * 0.4)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(*BY).orderBy(F.round("confidence", 9).desc(), c("wins").desc(), F.round("score", 9).desc(), "mode", "tonic")))


def amodal(scores: DataFrame) -> DataFrame:
    """36 scores to 24: a minor key takes the better of its minor and amodal template. Before that scores are spread from 0 to 1 over a
    segment's 36, so the vote is :func:`amodal_vote`."""
    keep = [x for x in scores.columns if x not in ("mode", "score")]
    mode = F.when(c("mode") == "other", "minor").otherwise(c("mode"))
    return scores.groupBy(*keep, mode.alias("mode")).agg(F.max("score").alias("score"))


def amodal_vote(scores: DataFrame) -> DataFrame:
    """The soft vote of one family with 36 templates: min-max over a segment's 36 scores, then the 24 keys, summed over segments."""
    seg = Window.partitionBy(*BY, "segment")
    low, high = F.min("score").over(seg), F.max("score").over(seg)
    spread = scores.withColumn("score", (c("score") - low) / F.greatest(high - low, F.lit(1e-10))).drop("family")
    total = amodal(spread).groupBy(*BY, "mode", "tonic").agg(F.sum("score").alias("total"))
    share = total.withColumn("confidence", F.try_divide("total", F.sum("total").over(Window.partitionBy(*BY))))
    return share.withColumn("rank", F.row_number().over(Window.partitionBy(*BY).orderBy(F.round("total", 9).desc(), "mode", "tonic")))


UNSTABLE = "no stable key"


def _key_names(tonic: Column, mode: Column) -> tuple[Column, Column]:
    code = keys.key_to_camelot(tonic, mode == "major")
    return keys.camelot_to_standard(code), code


def key_timeline(scores: DataFrame, spans: DataFrame, least: float = 0.35) -> DataFrame:
    """Each segment's key (standard name and wheel code) with its seconds (spans: track_id, segment, start_s, end_s); segments under ``least``
    have no stable key and no code. With the track's own: whether it modulates, its global key by the hard vote, the vote's confidence,
    and whether the track abstains, that is, no segment is stable or the global confidence is under ``least``."""
    won = segment_winners(scores).withColumn("confidence", F.lit(0.6) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("score"))) * 0.4)
    name, code = _key_names(c("tonic"), c("mode"))
    stable = c("confidence") >= least
    got = won.select(*BY, "segment", F.when(stable, name).otherwise(UNSTABLE).alias("key"), F.when(stable, code).otherwise("").alias("wheel"), "confidence").join(spans, [*BY, "segment"])
    name, code = _key_names(c("tonic"), c("mode"))
    top = hard_vote(scores).where("rank = 1").select(*BY, name.alias("g"), code.alias("gw"), c("confidence").alias("global_confidence"))
    over = Window.partitionBy(*BY)
    got = got.join(top, BY).withColumn("modulates", F.size(F.collect_set(F.when(c("wheel") != "", c("wheel"))).over(over)) > 1)
    got = got.withColumn("abstained", (F.max(F.when(c("wheel") != "", 1).otherwise(0)).over(over) == 0) | (c("global_confidence") < least))
    return got.select(*BY, "segment", "start_s", "end_s", "key", "wheel", "confidence", "modulates", F.when(c("abstained"), UNSTABLE).otherwise(c("g")).alias("global_key"), F.when(c("abstained"), "").otherwise(c("gw")).alias("global_wheel"), "global_confidence", "abstained")


def modulation_summary(timeline: DataFrame) -> DataFrame:
    """``Opens A minor, shifts to C major at 1:30``: a track's first stable key, then each change with its time; empty if it does not modulate.

    The minutes are rounded, as the texts to match have them."""
    w = Window.partitionBy(*BY).orderBy("segment")
    stable = timeline.where("wheel <> ''").withColumn("before", F.lag("wheel").over(w)).where("before is null or before <> wheel")
    second = c("start_s") % 60
    clock = F.concat(F.format_string("%.0f", F.rint(c("start_s") / 60)), F.lit(":"), F.when(second == F.floor(second), F.format_string("%02d", F.floor(second))).otherwise(second.cast("string")))
    step = F.when(c("before").isNull(), F.concat(F.lit("Opens "), c("key"))).otherwise(F.concat(F.lit("shifts to "), c("key"), F.lit(" at "), clock))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", step.alias("t")))), lambda r: r["t"]), ", ")
    told = stable.groupBy(*BY).agg(text.alias("t"), F.first("modulates").alias("m"))
    return timeline.select(*BY).distinct().join(told, BY, "left").select(*BY, F.when(c("m"), c("t")).otherwise("").alias("summary"))


def onset_from_energy(frames: DataFrame) -> DataFrame:
    """Rises of a frame's energy over nine tenths of the one before."""
    e = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    got = frames.select("track_id", "frame", e.alias("e"))
    return got.select("track_id", "frame", F.greatest(c("e") - 0.9 * F.coalesce(F.lag("e").over(_over()), c("e")), F.lit(0.0)).alias("onset"))


def autocorrelation(onset: DataFrame, max_lag: int) -> DataFrame:
    """(track_id, lag, value), lag 0 being 1; missing frames are 0. Blocks of frames are correlated and added up."""
    got = lag_products(onset, "onset", max_lag).where("lag < n")
    zero = F.first("raw").over(Window.partitionBy(*BY).orderBy("lag"))
    return got.select(*BY, "lag", F.when(zero > 0, c("raw") / zero).otherwise(0.0).alias("value"))


def autocorrelation_by_join(onset: DataFrame, max_lag: int) -> DataFrame:
    """The self-join form: frames against frames ``lag`` later. The form to check the other by. Frames meet in blocks of ``max_lag`` + 1: one looks
    into its own and the next, so a frame is shuffled three times, not once a lag."""
    block = F.floor(c("frame") / F.lit(max_lag + 1)).cast("long")
    asked = onset.select(*BY, c("frame").alias("at"), c("onset").alias("now"), block.alias("block"))
    later = onset.select(*BY, "frame", "onset", F.explode(F.array(block, block - 1)).alias("block"))
    each = asked.join(later.hint("merge"), [*BY, "block"]).withColumn("lag", (c("frame") - c("at")).cast("int")).where(c("lag").between(0, max_lag))
    got = each.groupBy(*BY, "lag").agg(F.sum(c("now") * c("onset")).alias("raw"))
    zero = onset.groupBy(*BY).agg(F.sum(c("onset") * c("onset")).alias("zero"))
    return got.join(zero, BY).select(*BY, "lag", F.when(c("zero") > 0, c("raw") / c("zero")).otherwise(0.0).alias("value"))


def peaks(ac: DataFrame, min_lag: int, max_lag: int, top: int = 10, apart: int = 3) -> DataFrame:
    """Strict local maxima above 0, merged within ``apart`` lags keeping the stronger, the ``top`` strongest, with parabolic places."""
    w = Window.partitionBy(*BY).orderBy("lag")
    at = ac.select("*", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("z")).where(c("lag").between(min_lag, max_lag) & (c("value") > 0))
    high = at.where((F.coalesce("a", F.lit(float("-inf"))) < c("value")) & (F.coalesce("z", F.lit(float("-inf"))) < c("value")))
    bend = c("a") - 2 * c("value") + c("z")
    place = F.when(F.abs(bend) >= 1e-10, c("lag") + 0.5 * (c("a") - c("z")) / bend).otherwise(c("lag").cast("double"))
    listed = high.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("lag", c("value").alias("strength"), F.coalesce(place, c("lag").cast("double")).alias("place")))).alias("l"))
    # merging is sequential: a fold over one track's few peaks
    last = lambda s: F.element_at(s, -1)
    step = lambda s, p: F.when((F.size(s) > 0) & (p["lag"] - F.try_element_at(s, F.lit(-1))["lag"] <= apart), F.when(p["strength"] > last(s)["strength"], F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(p))).otherwise(s)).otherwise(F.concat(s, F.array(p)))
    merged = listed.select(*BY, F.explode(F.aggregate("l", F.slice("l", 1, 0), step)).alias("p")).select(*BY, "p.*")
    rank = Window.partitionBy(*BY).orderBy(c("strength").desc(), "lag")
    return merged.withColumn("rank", F.row_number().over(rank)).where(c("rank") <= top)


def tempo(peaks_: DataFrame, tracks: DataFrame, low: float = 40.0, high: float = 220.0, rate: float = FRAME_RATE) -> DataFrame:
    """Peaks at half, whole and double tempo, weighted by preference; the best, its confidence 1 - second/first; 120 without peaks."""
    bpm = 60.0 * rate / c("place")
    each = peaks_.select(*BY, "strength", bpm.alias("base"), F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("m")).withColumn("bpm", c("base") * c("m")).where(c("bpm").between(low, high)).withColumn("score", c("strength") * tempo_preference(c("bpm")))
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*BY).orderBy(c("score").desc(), "bpm"))).where("r <= 2")
    got = ranked.groupBy(*BY).agg(F.max(F.when(c("r") == 1, c("bpm"))).alias("bpm"), F.max(F.when(c("r") == 1, c("score"))).alias("s1"), F.max(F.when(c("r") == 2, c("score"))).alias("s2"))
    sure = F.when(c("s1") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("s2", F.lit(0.0)) / c("s1")))).otherwise(0.0)
    return tracks.select(*BY).distinct().join(got, BY, "left").select(*BY, F.coalesce("bpm", F.lit(120.0)).alias("bpm"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def moving_average(df: DataFrame, value: str, radius: int = 3) -> DataFrame:
    """edges shrink."""
    return df.withColumn(value, F.avg(value).over(_over().rowsBetween(-radius, radius)))


def whiten(onset: DataFrame, radius: int) -> DataFrame:
    """square root of each value over the largest around it."""
    top = F.max("onset").over(_over().rowsBetween(-radius, radius))
    return onset.withColumn("onset", F.when(top > 0, F.sqrt(c("onset") / top)).otherwise(0.0))


def spectral_flux(spec: DataFrame, edges: list[int]) -> DataFrame:
    """Rises of each bin, summed in bands of bins cut at ``edges``, each band and their sum over its largest, smoothed. The
    spectrogram is shuffled once; what follows has a row a frame."""
    flux = materialize(band_flux(spec, edges), "flux")
    bands = [x for x in flux.columns if x.startswith("b")]
    top = flux.groupBy(*BY).agg(*(F.max(b).alias(f"m{b}") for b in bands))
    share = lambda x, m: F.when(m > 0, x / m).otherwise(0.0)
    total = flux.join(top, BY).select(*BY, "frame", reduce(Column.__add__, (share(c(b), c(f"m{b}")) for b in bands)).alias("onset"))
    over = total.join(total.groupBy(*BY).agg(F.max("onset").alias("most")), BY).select(*BY, "frame", share(c("onset"), c("most")).alias("onset"))
    near = Window.partitionBy(*BY, "_block").orderBy("frame").rowsBetween(-3, 3)
    smooth = haloed(over, 3, 3, SMOOTH).withColumn("onset", F.avg("onset").over(near))
    return smooth.where(own(length=SMOOTH)).drop("_block")


def expand_grid(grids: DataFrame, duration_ms: Column) -> DataFrame:
    """Beats of a grid up to a duration: index, time, bar, beat of the bar, downbeat."""
    step = 60000.0 / c("bpm")
    n = F.floor((duration_ms - c("first_beat_ms")) / step).cast("int")
    each = grids.withColumn("_n", n).where("_n >= 0").select("*", F.explode(F.sequence(F.lit(0), c("_n"))).alias("beat"))
    at = F.pmod(c("beat") - c("downbeat_offset_beats"), c("meter_numerator"))
    return each.select("track_id", "source", "beat", (c("first_beat_ms") + c("beat") * step).alias("ms"), F.floor((c("beat") - c("downbeat_offset_beats")) / c("meter_numerator")).cast("int").alias("bar"), at.cast("int").alias("beat_in_bar"), (at == 0).alias("is_downbeat"))


def snap(beats: DataFrame, onset: DataFrame, reach: int = 3) -> DataFrame:
    """(track_id, beat, frame) moved to the strongest onset within ``reach`` frames, the earliest of equals; a beat stays where
    none is stronger than its own frame's. The range is a few exact frames, so the join is an equi-join."""
    near = beats.select("track_id", "beat", c("frame").alias("at"), F.explode(F.sequence(c("frame") - reach, c("frame") + reach)).alias("frame")).join(onset, ["track_id", "frame"], "left")
    here = F.max(F.when(c("frame") == c("at"), c("onset")))
    best = F.max(F.when(c("onset").isNotNull(), F.struct("onset", (-c("frame")).alias("f"))))
    got = near.groupBy("track_id", "beat", "at").agg(best.alias("m"), F.coalesce(here, F.lit(0.0)).alias("own"))
    return got.select("track_id", "beat", F.when(c("m.onset") > c("own"), -c("m.f")).otherwise(c("at")).alias("frame"))


def interval_bpm(beats: DataFrame, start: DataFrame, rate: float = FRAME_RATE) -> DataFrame:
    """Tempo from the upper median of beat intervals, blended .7 to .3 with a start tempo (track_id, bpm); the start tempo itself if the
    median is about an octave off (over 1.8 or under 0.55 times it) or there is no interval."""
    gap = (c("frame") - F.lag("frame").over(Window.partitionBy(*BY).orderBy("frame"))) / rate
    mid = beats.withColumn("gap", gap).groupBy(*BY).agg(upper_median(F.collect_list("gap")).alias("gap"))
    raw = F.when(c("gap") > 0, 60.0 / c("gap"))
    kept = F.when((raw <= c("bpm") * 1.8) & (raw >= c("bpm") * 0.55), raw * 0.7 + c("bpm") * 0.3)
    return mid.join(start, BY).select(*BY, F.coalesce(kept, "bpm").alias("bpm"))


# fixed values: meter, weights of its beats, preference; in the order that decides ties
METERS = [(4, [1.0, 0.7, 0.8, 0.7], 1.05), (3, [1.0, 0.7, 0.8], 1.0), (2, [1.0, 0.7], 0.95), (6, [1.0, 0.5, 0.6, 0.8, 0.5, 0.6], 1.0)]


def meter(beats: DataFrame, onset: DataFrame) -> DataFrame:
    """Meter, downbeat offset and confidence of (track_id, beat, frame) over 15 hypotheses, a broadcast table; 4, 0, 0 with under eight beats."""
    spark = beats.sparkSession
    rows = [(k, m, o, w, pref) for k, (m, w, pref) in enumerate(METERS) for o in range(m)]
    guess = spark.createDataFrame(rows, "k int, meter int, off int, w array<double>, pref double")
    heard = beats.join(onset, ["track_id", "frame"], "left").withColumn("onset", F.coalesce("onset", F.lit(0.0)))
    score = heard.crossJoin(F.broadcast(guess)).groupBy("track_id", "k", "meter", "off").agg((F.avg(c("onset") * F.get("w", F.pmod(c("beat") + c("off"), c("meter")).cast("int"))) * F.first("pref")).alias("score"), F.count("*").alias("n"))
    ranked = score.where("n >= 8").withColumn("r", F.row_number().over(Window.partitionBy(*BY).orderBy(F.round("score", 9).desc(), "k", "off"))).where("r <= 2")
    got = ranked.groupBy(*BY).agg(F.max(F.when(c("r") == 1, F.struct("meter", "off", "score"))).alias("a"), F.max(F.when(c("r") == 2, c("score"))).alias("b"))
    sure = F.when((c("b") > 0) & (c("a.score") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - c("b") / c("a.score")))).otherwise(0.0)
    return beats.select(*BY).distinct().join(got, BY, "left").select(*BY, F.coalesce("a.meter", F.lit(4)).alias("meter"), F.coalesce("a.off", F.lit(0)).alias("off"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def beat_confidence(beats: DataFrame, onset: DataFrame) -> DataFrame:
    """Each beat's onset over the track's mean, 0 to 3, as a share of 3."""
    mean = onset.groupBy(*BY).agg(F.avg("onset").alias("mean"))
    got = beats.join(onset, ["track_id", "frame"], "left").join(mean, "track_id", "left")
    return got.select("track_id", "beat", F.when(c("mean") > 1e-10, F.least(F.lit(3.0), F.coalesce("onset", F.lit(0.0)) / c("mean")) / 3).otherwise(0.0).alias("confidence"))


def grid_confidence(beats: DataFrame, onset: DataFrame, tempo_confidence: float, reach: int = 3) -> DataFrame:
    """.6 of how far the strongest onsets around beats exceed the mean (up to five times), .4 of the tempo's confidence. Tracks without
    onsets around any beat keep the tempo's part."""
    near = beats.select("track_id", "beat", F.explode(F.sequence(c("frame") - reach, c("frame") + reach)).alias("frame")).join(onset, ["track_id", "frame"])
    top = near.groupBy("track_id", "beat").agg(F.greatest(F.max("onset"), F.lit(0.0)).alias("m")).groupBy(*BY).agg(F.avg("m").alias("m"))
    mean = onset.groupBy(*BY).agg(F.avg("onset").alias("mean"))
    ratio = F.when(c("mean") > 1e-10, F.least(F.lit(5.0), F.coalesce("m", F.lit(0.0)) / c("mean")) / 5).otherwise(0.0)
    return beats.select(*BY).distinct().join(top, BY, "left").join(mean, BY, "left").select(*BY, (ratio * 0.6 + 0.4 * tempo_confidence).alias("confidence"))


# fixed values: weights of bias, loudness, brightness, onsets and percussion in the energy level
ENERGY = (1.0, 0.15, 0.001, 0.5, 2.0)


def energy(frames: DataFrame, rate: int) -> DataFrame:
    """Loudness, zero crossings, onset density and percussive share of (track_id, frame, samples) with 20 ms frames, and the 1 to 10 level.

    The percussive share is that of what is left over a moving mean of the last rate/500 samples; it and the crossings reach into the frame
    before. Only the last frame of a track may be shorter, and then has no part in the onsets."""
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    n, width = F.size("samples"), max(rate // 500, 2)
    cross = F.aggregate(F.zip_with(F.slice("samples", F.lit(1), n - 1), F.slice("samples", F.lit(2), n - 1), lambda a, b: F.when((a >= 0) != (b >= 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    rows = frames.where(n > 0).select("track_id", "frame", "samples", F.lag(F.slice("samples", F.greatest(n - width + 1, F.lit(1)), F.lit(width))).over(_over()).alias("before_it"))
    held = F.coalesce("before_it", F.array().cast("array<double>"))
    rows = rows.select("track_id", "frame", "samples", F.concat(held, "samples").alias("x"), F.size(held).alias("k"))
    # the mean of a sample and the width ones before it, over width; a track's first samples are their own
    mean = lambda i: F.when(c("k") + i >= width, F.aggregate(F.slice("x", c("k") + i - width + 1, F.lit(width + 1)), F.lit(0.0), lambda s, v: s + v) / width).otherwise(F.get("samples", i))
    rows = rows.withColumn("low", F.transform(F.sequence(F.lit(0), n - 1), mean))
    first, last = F.get("samples", F.lit(0)), F.element_at("samples", -1)
    per = rows.select("track_id", "frame", n.alias("n"), sq(c("samples")).alias("e"), cross.alias("z"), first.alias("first"), last.alias("last"), sq(c("low")).alias("low"), sq(F.zip_with("samples", "low", lambda a, b: a - b)).alias("high"))
    per = per.withColumn("z", c("z") + F.coalesce(F.when((F.lag("last").over(_over()) >= 0) != (c("first") >= 0), 1).otherwise(0), F.lit(0)))
    per = per.withColumn("p", F.when(c("n") >= rate // 50, c("e") / c("n"))).withColumn("before", F.lag("p").over(_over()))
    per = per.withColumn("avg_p", F.avg("p").over(Window.partitionBy(*BY)))
    got = per.groupBy(*BY).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("z").alias("z"), F.count_if((c("p") > 3 * c("avg_p")) & (c("p") > 1.5 * c("before"))).alias("on"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    rms, seconds = F.sqrt(c("e") / c("n")), c("n") / rate
    loud = 20 * F.greatest(F.when(rms > 0, F.log10(rms)).otherwise(F.lit(-60.0)), F.lit(-60.0))
    centroid = F.least(c("z") / seconds * rate / 2, F.lit(20000.0))
    density, share = c("on") / F.greatest(seconds, F.lit(0.1)), c("high") / (c("low") + c("high") + 1e-10)
    bias, *w = ENERGY
    raw = bias + w[0] * F.greatest(loud + 30, F.lit(0.0)) + w[1] * centroid + w[2] * density + w[3] * share
    return got.select(*BY, loud.alias("loudness_db"), centroid.alias("centroid_hz"), density.alias("onset_density"), share.alias("high_share"), F.least(F.lit(10), F.greatest(F.lit(1), F.floor(raw + 0.5))).cast("int").alias("energy_level"))


def waveform(spec: DataFrame, edges: tuple[int, int], columns: int = 2000) -> DataFrame:
    """Peak magnitudes of three bands in up to ``columns`` columns, over the track's largest."""
    last = F.max("frame").over(Window.partitionBy(*BY)) + 1
    col = F.floor(c("frame") / (F.greatest(last, F.lit(columns)) / columns)).cast("int")
    got = spec.withColumn("column", col).groupBy("track_id", "column").agg(*(F.max(F.when(w, c("mag"))).alias(x) for x, w in (("low", c("bin") < edges[0]), ("mid", (c("bin") >= edges[0]) & (c("bin") < edges[1])), ("high", c("bin") >= edges[1]))))
    top = F.max(F.greatest(*(F.coalesce(x, F.lit(0.0)) for x in ("low", "mid", "high")))).over(Window.partitionBy(*BY))
    return got.select("track_id", "column", *(F.when(top > 0, F.coalesce(x, F.lit(0.0)) / top).otherwise(0.0).alias(x) for x in ("low", "mid", "high")))


def feature_matrix(frames: DataFrame, array: str, n_frames: int) -> DataFrame:
    """Z-scores over a track's values, cut or zero-padded to ``n_frames`` rows."""
    flat = frames.select(*BY, "frame", F.posexplode(array).alias("i", "x"))
    stats = flat.groupBy(*BY).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = frames.join(stats, BY).select(*BY, "frame", F.transform(array, lambda x: (x - c("m")) / (c("sd") + 1e-8)).alias(array))
    listed = z.where(c("frame") < n_frames).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("frame", array))).alias("l"), F.first(F.size(array)).alias("w"))
    rows = F.transform("l", lambda r: r[array])
    return listed.select(*BY, F.concat(rows, F.array_repeat(F.array_repeat(F.lit(0.0), c("w")), n_frames - F.size("l"))).alias("matrix"))


def augment(labelled: DataFrame, array: str, shifts: list[int]) -> DataFrame:
    """I32: copies with pitches rolled by each shift, and the 24-class label with them."""
    each = labelled.select("*", F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    n, k = F.size(array), F.pmod(-c("shift"), F.size(array))
    turned = F.concat(F.slice(array, k + 1, n - k), F.slice(array, F.lit(1), k))
    tonic = F.pmod(c("label") % 12 + c("shift"), F.lit(12))
    return each.withColumn(array, turned).withColumn("label", tonic + F.when(c("label") < 12, 0).otherwise(12))


def time_roll(matrices: DataFrame, array: str, seed: int, copies: int = 4, most: int = 50) -> DataFrame:
    """I32: ``copies`` of every row with its frames (the outer array) rolled by a seeded shift of -``most`` to ``most`` - 1, as column shift; labels stay."""
    each = matrices.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    shift = (F.pmod(F.xxhash64(F.lit(seed), *BY, "copy"), F.lit(2 * most)) - most).cast("int")
    each = each.withColumn("shift", shift)
    n, k = F.size(array), F.pmod(-c("shift"), F.greatest(F.size(array), F.lit(1))).cast("int")
    return each.withColumn(array, F.concat(F.slice(array, k + 1, n - k), F.slice(array, F.lit(1), k)))


def tempo_in_force(beats: DataFrame, tempo_map: DataFrame) -> DataFrame:
    """As-of join: the last tempo segment (track_id, start_ms, bpm) at or before each beat (track_id, beat, ms)."""
    marks = tempo_map.select("track_id", c("start_ms").alias("ms"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("beat"), "bpm")
    both = beats.select("track_id", "ms", F.lit(1).alias("k"), c("beat").cast("int").alias("beat")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*BY).orderBy("ms", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bpm", F.last("bpm", True).over(w)).where("k = 1").select("track_id", "beat", "ms", "bpm")


def windowed_vote(scores: DataFrame, seconds_per_segment: float, length: float = 30.0, step: float = 15.0) -> DataFrame:
    """L3: overlapping windows vote with their confidence as weight; windows under 0.3 drop; modulating if two keys hold over 0.3 each."""
    at = c("segment") * seconds_per_segment
    k = F.floor(at / step)
    each = scores.select("*", F.explode(F.sequence(F.greatest(k - int(length / step) + 1, F.lit(0)), k)).alias("window"))
    mean = each.groupBy(*BY, "window", "mode", "tonic").agg(F.avg("score").alias("score"))
    best = segment_winners(mean.withColumnRenamed("window", "segment")).where("score >= 0.3")
    got = best.groupBy(*BY, "mode", "tonic").agg(F.sum("score").alias("weight"))
    share = got.withColumn("share", c("weight") / F.sum("weight").over(Window.partitionBy(*BY)))
    return share.withColumn("modulating", F.count_if(c("share") > 0.3).over(Window.partitionBy(*BY)) > 1)
