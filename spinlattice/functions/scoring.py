"""Scores of predictions against truths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mirex(pt: Column, pm: Column, tt: Column, tm: Column) -> Column:
    """1 exact, .5 a fifth either way, .3 relative, .2 parallel, else 0."""
    d = F.pmod(pt - tt, F.lit(12))
    return (
        F.when((d == 0) & (pm == tm), 1.0).when((pm == tm) & d.isin(5, 7), 0.5).when(tm & ~pm & (d == 9), 0.3).when(~tm & pm & (d == 3), 0.3)
        .when((d == 0) & (pm != tm), 0.2).otherwise(0.0)
    )


def mirex_one_sided(pt: Column, pm: Column, tt: Column, tm: Column) -> Column:
    """As mirex(), but only the fifth above counts."""
    d = F.pmod(pt - tt, F.lit(12))
    return F.when((pm == tm) & (d == 5), 0.0).otherwise(mirex(pt, pm, tt, tm))


def error_class(pt: Column, pm: Column, tt: Column, tm: Column) -> Column:
    """C16."""
    d = F.pmod(pt - tt, F.lit(12))
    return (
        F.when((d == 0) & (pm == tm), "correct").when(d == 0, "parallel").when((tm & ~pm & (d == 9)) | (~tm & pm & (d == 3)), "relative")
        .when((pm == tm) & d.isin(5, 7), "fifth").when(d.isin(1, 11), "semitone").otherwise("other")
    )


def within_one(pred: Column, truth: Column, octaves: bool) -> Column:
    """Tempo agreement within a beat a minute, raw or after halving or doubling."""
    near = lambda m: F.abs(pred * m - truth) <= 1.0
    return near(0.5) | near(1.0) | near(2.0) if octaves else near(1.0)


def best_octave_error(pred: Column, truth: Column) -> Column:
    """The signed error of least size over half, whole and double tempo; the smaller factor wins ties."""
    each = F.array(*(F.struct(F.abs(pred * m - truth).alias("size"), F.lit(m).alias("m"), (pred * m - truth).alias("error")) for m in (0.5, 1.0, 2.0)))
    return F.when(pred.isNotNull() & truth.isNotNull(), F.array_min(each)["error"])


def bpm_ratio(pred: Column, truth: Column) -> Column:
    return F.when(truth > 0, pred / truth).otherwise(1.0)


def tempo_preference(bpm: Column) -> Column:
    """A Gaussian on the octave scale about 120."""
    return F.exp(-0.5 * F.pow(F.log2(bpm / 120.0), F.lit(2.0)))


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper of two; null for none. Not a percentile."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))
