"""Filters and rates of long recordings by blocks with halos: each block is a row that holds its neighbours' nearest samples too,
so a recording is as many tasks as Spark likes, and what comes out is the same at every block's edge as everywhere else."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def halo_blocks(samples: DataFrame, keys: list[str], *, size: int, halo: int, value: str = "value") -> DataFrame:
    """(keys, block, n, first, x): the values from `first` on, of each block of `size` samples and up to `halo` more on either
    side; n is the series' length. One shuffle; a sample goes to its own block and to those that it lies near.

    Samples count from 0; null and missing values are taken as 0, so fill gaps before.
    """
    d = samples.select(*keys, "sample_idx", F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("v"))
    n = d.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("n"))
    d = d.join(n, keys)
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("sample_idx") - halo) / size))
    high = F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("sample_idx") + halo) / size))
    d = d.withColumn("block", F.explode(F.sequence(low, high)))
    g = d.groupBy(*keys, "block", "n").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "v"))).alias("_x"))
    return g.select(*keys, "block", "n", F.greatest(F.lit(0).cast("long"), F.col("block") * size - halo).alias("first"), F.col("_x.sample_idx").alias("at"), F.col("_x.v").alias("x"))


def extended(x: np.ndarray, first: int, n: int, start: int, stop: int) -> np.ndarray:
    """The series from start to stop, which may lie outside it: there it goes on as its mirror image, turned about the end
    value, for as long as it is itself, and as 0 beyond. x holds it from `first` on, as far as is needed."""
    at = np.arange(start, stop)
    before, after = at < 0, at >= n
    place = np.where(before, -at, np.where(after, 2 * (n - 1) - at, at))
    held = (place >= 0) & (place < n)
    v = np.where(held, x[np.clip(place - first, 0, len(x) - 1)], 0.0)
    if start < 0:
        v[before & held] = 2 * x[0] - v[before & held]
    if stop > n:
        v[after & held] = 2 * x[n - 1 - first] - v[after & held]
    return v


def low_pass_taps(fs: float, cutoff: float, transition: float) -> np.ndarray:
    """A windowed sinc (Hamming) with a sum of 1, of 3.3 / transition seconds (an odd number of taps)."""
    n = int(round(3.3 * fs / transition))
    n += 1 - n % 2
    t = np.arange(n) - n // 2
    h = np.sinc(2 * cutoff / fs * t) * (0.54 + 0.46 * np.cos(np.pi * t / max(n // 2, 1)))
    return h / h.sum()


def band_pass_taps(fs: float, low: float | None, high: float | None) -> np.ndarray:
    """A linear-phase band-pass (low or high None: low- or high-pass), with transitions of a quarter of the edge, at least
    2 Hz, within the spectrum; each edge's cutoff lies in the middle of its transition, and each has taps of its own length."""
    up = down = None
    if high is not None and high < fs / 2:
        width = min(max(0.25 * high, 2.0), fs / 2 - high)
        up = low_pass_taps(fs, high + width / 2, width)
    if low:
        width = min(max(0.25 * low, 2.0), low)
        down = low_pass_taps(fs, low - width / 2, width)
    n = max(len(h) for h in (up, down, np.ones(1)) if h is not None)
    out = np.zeros(n)
    for h, sign in ((up, 1.0), (down, -1.0)):
        if h is not None:
            out[(n - len(h)) // 2 : (n + len(h)) // 2] += sign * h
    if up is None:
        out[n // 2] += 1.0
    return out


def _whole(at: np.ndarray, x: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The values from first to stop, 0 where there is none."""
    out = np.zeros(stop - first)
    out[np.asarray(at, np.int64) - first] = x
    return out


def convolve(samples: DataFrame, keys: list[str], taps: np.ndarray, *, value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, sample_idx, filtered): the series convolved with symmetric taps without delay, mirrored at its ends.

    A block is at least eight times the halo, unless `block` gives its samples.
    """
    half = len(taps) // 2
    size = block or max(4096, 8 * half)

    @F.pandas_udf("array<double>")
    def run(at: pd.Series, x: pd.Series, first: pd.Series, number: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, v, f, b, m in zip(at, x, first, number, n, strict=True):
            start, stop = b * size, min((b + 1) * size, m)
            wide = extended(_whole(p, v, f, min(m, stop + half)), f, m, start - half, stop + half)
            width = 1 << (len(wide) + len(taps) - 2).bit_length()
            whole = np.fft.irfft(np.fft.rfft(wide, width) * np.fft.rfft(taps, width), width)
            out.append(whole[2 * half : 2 * half + stop - start])
        return pd.Series(out)

    b = halo_blocks(samples, keys, size=size, halo=half, value=value)
    b = b.select(*keys, "block", F.posexplode(run("at", "x", "first", "block", "n")).alias("_i", "filtered"))
    return b.select(*keys, (F.col("block") * size + F.col("_i")).alias("sample_idx"), "filtered")


def fir_band_pass(samples: DataFrame, keys: list[str], *, fs: float, low: float | None, high: float | None, value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, sample_idx, filtered): zero-phase band-pass by the taps of band_pass_taps."""
    return convolve(samples, keys, band_pass_taps(fs, low, high), value=value, block=block)


def notch_band(samples: DataFrame, keys: list[str], *, fs: float, freqs: list[float], width: float, value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, sample_idx, filtered): zero-phase band-stop of `width` Hz about each frequency below half the rate, with
    transitions of half that width on each side."""
    taps = np.ones(1)
    for f in sorted({f for f in freqs if f + width < fs / 2}):
        stop = low_pass_taps(fs, f + width / 2, width / 2) - low_pass_taps(fs, f - width / 2, width / 2)
        own = -stop
        own[len(own) // 2] += 1.0
        taps = np.convolve(taps, own)
    return convolve(samples, keys, taps, value=value, block=block)


def resample_weights(up: int, down: int, crossings: int) -> tuple[np.ndarray, int]:
    """Weights of the 2 H + 1 samples about each of `up` phases between two samples, and H: a sinc below the lower of both
    half rates, under a Kaiser window over `crossings` of its zeros to either side; each phase adds up to 1."""
    slow = min(1.0, up / down)
    # The transition of the window (a Kaiser parameter of 8.6 gives about 86 dB) ends at the lower half rate.
    cutoff = slow * (1 - 2.9 / crossings) if crossings > 6 else slow
    half = int(np.ceil(crossings / slow))
    t = np.arange(-half, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(t) <= crossings / slow, np.i0(8.6 * np.sqrt(np.maximum(0.0, 1 - (t * slow / crossings) ** 2))), 0.0)
    w = np.sinc(cutoff * t) * window
    return w / w.sum(axis=1, keepdims=True), half


def resample(samples: DataFrame, keys: list[str], *, old: int, new: int, crossings: int = 48, value: str = "value", block: int | None = None) -> DataFrame:
    """(keys, sample_idx, value): the series at the rate `new` instead of `old` (whole numbers of Hz), round(n new / old) samples
    of it, the first at the first's time; mirrored at its ends. Equal rates give the series itself.

    Each output sample weighs the samples about its time by the phase it falls in; a block gives those whose times lie in it.
    """
    g = gcd(old, new)
    up, down = new // g, old // g
    if up == down:
        return samples.select(*keys, "sample_idx", F.col(value).alias("value"))
    weights, half = resample_weights(up, down, crossings)
    size = block or max(4096, 8 * half)

    @F.pandas_udf("struct<start: bigint, y: array<double>>")
    def run(at: pd.Series, x: pd.Series, first: pd.Series, number: pd.Series, n: pd.Series) -> pd.DataFrame:
        starts, out = [], []
        for p, v, f, b, m in zip(at, x, first, number, n, strict=True):
            begin, end, whole = b * size, min((b + 1) * size, m), int(np.round(m * up / down))
            j = np.arange(-(-begin * up // down), whole if end == m else min(whole, -(-end * up // down)))
            wide = extended(_whole(p, v, f, min(m, end + half + 1)), f, m, begin - half, end + half + 1)
            near = np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1)[j * down // up - begin]
            starts.append(j[0] if len(j) else 0)
            out.append(np.einsum("ij,ij->i", near, weights[j * down % up]))
        return pd.DataFrame({"start": starts, "y": out})

    b = halo_blocks(samples, keys, size=size, halo=half + 1, value=value)
    b = b.withColumn("_r", run("at", "x", "first", "block", "n")).select(*keys, "_r.start", F.posexplode("_r.y").alias("_i", "value"))
    return b.select(*keys, (F.col("start") + F.col("_i")).alias("sample_idx"), "value")
