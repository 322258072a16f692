"""Long series cut into blocks of frames with a halo, so that a window, a lag or a running median needs one shuffle and no track is one task.

A block holds its frames and copies of those within reach beyond its borders; what a task holds is bounded by the block, whatever a track's
length. Kernels are numpy over a block's matrix (frames by bins).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import numbered

c = F.col
#: Frames of a block.
LENGTH = 512


def haloed(df: DataFrame, before: int, after: int, length: int = LENGTH, frame: str = "frame") -> DataFrame:
    """Rows (frames from 0 on) with their ``_block``, and copies for the blocks that begin up to ``before`` frames later or end up to ``after`` frames earlier."""
    at = lambda x: F.floor(x / F.lit(length)).cast("long")
    return df.withColumn("_block", F.explode(F.sequence(F.greatest(at(c(frame) - after), F.lit(0)), at(c(frame) + before))))


def own(frame: str = "frame", length: int = LENGTH) -> Column:
    """Whether a row is its block's own and no copy."""
    return F.floor(c(frame) / F.lit(length)).cast("long") == c("_block")


def running_upper_median(x: np.ndarray, radius: int) -> np.ndarray:
    """Along the first axis: of the values within ``radius`` places the sorted one at half their number; NaN places have no value and count for none.

    A window moves by one value: it is kept sorted for all columns at once, the leaving value's place is closed up and the
    entering one's opened, which costs the window's width a step and no sort."""
    n, k = len(x), 2 * radius + 1
    high = np.where(np.isnan(x), np.inf, x)
    pad = np.full((radius, *x.shape[1:]), np.inf)
    padded = np.concatenate([pad, high, pad])
    counts = np.cumsum(np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.isfinite(padded).astype(np.int64)]), axis=0)
    sizes = counts[k:] - counts[:-k]
    window = np.sort(padded[:k], axis=0)
    out = np.empty_like(high)
    for i in range(n):
        if i:
            leaves, enters = padded[i - 1], padded[i + k - 1]
            place = np.argmax(window == leaves, axis=0)  # where the value that leaves stands
            slots = np.arange(k).reshape(-1, *([1] * (x.ndim - 1)))
            closed = np.where(slots[: k - 1] < place, window[: k - 1], window[1:])
            opened = (closed < enters).sum(axis=0)
            up = np.concatenate([closed[:1], closed])
            down = np.concatenate([closed, closed[-1:]])
            window = np.where(slots < opened, down, np.where(slots == opened, enters, up))
        out[i] = np.take_along_axis(window, np.minimum(sizes[i] // 2, k - 1)[None], axis=0)[0]
    return np.where(np.isnan(x), np.nan, out)


def per_block(df: DataFrame, radius: tuple[int, int], columns: list[str], schema: str, kernel: Callable, length: int = LENGTH) -> DataFrame:
    """``kernel`` of each (track, block): it gets the first frame of the block's matrix, the matrix (frames by bins, NaN where there is no row) and
    the rows of it that are the block's own, and returns arrays for the columns of ``schema`` after track_id. One shuffle of the rows."""
    value, binned = columns[-1], len(columns) > 1

    def run(key, pdf):
        import pandas as pd

        first = int(pdf["frame"].min())
        frames = (pdf["frame"] - first).to_numpy()
        bins = pdf["bin"].to_numpy() if binned else np.zeros(len(pdf), np.int64)
        matrix = np.full((frames.max() + 1, bins.max() + 1), np.nan)
        matrix[frames, bins] = pdf[value].to_numpy(float)
        begin = int(key[1]) * length - first
        got = kernel(first, matrix, slice(max(begin, 0), max(begin + length, 0)))
        return pd.DataFrame({"track_id": key[0], **got})

    rows = haloed(df.select("track_id", "frame", *(c(x).cast("int" if x == "bin" else "double").alias(x) for x in columns)), *radius, length)
    return rows.groupBy("track_id", "_block").applyInPandas(run, f"track_id long, {schema}")


def cells(first: int, matrix: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """frame and bin of the cells in ``part`` that have a value, and where they are."""
    at = np.argwhere(~np.isnan(matrix[part]))
    return at[:, 0] + part.start + first, at[:, 1], (at[:, 0] + part.start, at[:, 1])


def harmonic_split(spec: DataFrame, radius: int = 8) -> DataFrame:
    """I4: harmonic and percussive parts of (track_id, frame, bin, mag): running medians along time and along frequency, and a soft mask.
    Windows are frames and bins by number; a cell without a row has no value there. One shuffle."""

    def kernel(first, matrix, part):
        frame, bin_, at = cells(first, matrix, part)
        h, p = running_upper_median(matrix, radius)[at], running_upper_median(matrix[part].T, radius).T[at[0] - part.start, at[1]]
        mag, mask = matrix[at], h * h / (h * h + p * p + 1e-10)
        return {"frame": frame, "bin": bin_, "harmonic": mag * mask, "percussive": mag * (1 - mask)}

    return per_block(spec, (radius, radius), ["bin", "mag"], "frame int, bin int, harmonic double, percussive double", kernel)


def sliding_upper_median(series: DataFrame, value: str, radius: int = 8, length: int = 1 << 16) -> DataFrame:
    """(track_id, frame, med) of (track_id, frame, ``value``): upper median over the ``radius`` rows on either side in order of frames, whatever
    their numbers; edges shrink. Null values have none. Blocks are cut by rows, across tracks."""

    def run(key, pdf):
        pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
        # one line of all tracks' values, with a gap as wide as the window's reach between tracks
        fresh = pdf["track_id"].to_numpy()
        line = np.arange(len(pdf)) + radius * (1 + np.cumsum(np.r_[0, fresh[1:] != fresh[:-1]]))
        x = pdf[value].to_numpy(float)
        laid = np.full(line[-1] + radius + 1, np.inf)
        laid[line] = np.where(np.isnan(x), np.inf, x)
        near = np.sort(np.lib.stride_tricks.sliding_window_view(laid, 2 * radius + 1)[line - radius], axis=1)
        half = np.isfinite(near).sum(axis=1) // 2
        pdf["med"] = np.where(np.isnan(x), np.nan, near[np.arange(len(x)), np.minimum(half, 2 * radius)])
        return pdf.loc[pdf["at"] // length == key[0], ["track_id", "frame", "med"]]

    rows = numbered(series.select("track_id", "frame", c(value).cast("double").alias(value)), ["track_id", "frame"], "series")
    return haloed(rows, radius, radius, length, "at").groupBy("_block").applyInPandas(run, "track_id long, frame int, med double")


def band_flux(spec: DataFrame, edges: list[int]) -> DataFrame:
    """(track_id, frame, b0, b1, ...): rises of each bin since the frame before, summed in bands of bins cut at ``edges``. One shuffle; a row a frame."""
    bands = len(edges) + 1

    def kernel(first, matrix, part):
        mag = np.nan_to_num(matrix)
        had = ~np.isnan(matrix)
        rise = np.zeros_like(mag)
        rise[1:] = np.where(had[1:] & had[:-1], np.maximum(mag[1:] - mag[:-1], 0), 0)
        rows = np.flatnonzero(had[part].any(axis=1)) + part.start
        cut = [0, *(min(e, mag.shape[1]) for e in edges), mag.shape[1]]
        sums = {f"b{i}": rise[rows, cut[i] : cut[i + 1]].sum(axis=1) for i in range(bands)}
        return {"frame": rows + first} | sums

    return per_block(spec, (1, 0), ["bin", "mag"], "frame int, " + ", ".join(f"b{i} double" for i in range(bands)), kernel)


def lag_products(series: DataFrame, value: str, max_lag: int) -> DataFrame:
    """(track_id, lag, raw, n): sums of products of frames and those ``lag`` later, and the number of frames up to the last; missing frames are 0.

    A block is correlated with itself and the next ``max_lag`` frames by FFT, and blocks add up their sums, so the work is n log n
    and no track is one array."""
    length = max(4096, 2 * max_lag)

    def kernel(first, matrix, part):
        x = np.nan_to_num(matrix[:, 0])
        y = np.zeros(part.stop - part.start + max_lag)
        held = x[part.start : part.start + len(y)]
        y[: len(held)] = held
        a = y[: part.stop - part.start]
        size = 1 << (len(a) + len(y)).bit_length()
        raw = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(y, size), size)[: max_lag + 1]
        raw[np.abs(raw) < 1e-13 * (a @ a)] = 0.0  # noise where no two values meet
        here = np.flatnonzero(~np.isnan(matrix[part, 0]))
        n = first + part.start + int(here.max()) + 1 if len(here) else 0
        return {"lag": np.arange(max_lag + 1), "raw": raw, "n": np.full(max_lag + 1, n)}

    parts = per_block(series, (0, max_lag), [value], "lag int, raw double, n long", kernel, length)
    return parts.groupBy("track_id", "lag").agg(F.sum("raw").alias("raw"), F.max("n").alias("n"))
