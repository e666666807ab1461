"""Line noise where there is any: a test by several tapers decides for each window and frequency whether its sine goes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@cache
def tapers(n: int, half_band: float, k: int, most: int = 1024) -> np.ndarray:
    """The first k discrete prolate spheroidal sequences of n values (rows, of unit length) for a time-bandwidth product of
    half_band: eigenvectors of the tridiagonal matrix that shares them. Longer ones than `most` are drawn from those of
    `most` by lines."""
    m = min(n, most)
    t = np.arange(m)
    matrix = np.diag(((m - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * half_band / m))
    beside = t[1:] * (m - t[1:]) / 2
    matrix[t[1:], t[:-1]] = matrix[t[:-1], t[1:]] = beside
    v = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
    if m < n:
        v = np.array([np.interp((np.arange(n) + 0.5) * m / n - 0.5, t, x) for x in v])
        v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    return v * np.where(v.sum(axis=1, keepdims=True) < -1e-9, -1.0, 1.0)


def tapers_for(n: int, fs: float, bandwidth: float) -> np.ndarray:
    """As many tapers as `bandwidth` Hz bear in n samples, at least two."""
    half_band = max(1.5, n * bandwidth / fs / 2)
    return tapers(n, half_band, max(2, int(2 * half_band - 1)))


def critical_f(k: int, p: float) -> float:
    """The value that Thomson's F of k tapers (2 and 2 k - 2 degrees of freedom) exceeds by chance with probability p."""
    return (k - 1) * (p ** (-1 / (k - 1)) - 1)


def sine_test(x: np.ndarray, v: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """F of a sine of `angle` a sample in each row of x, and its complex amplitude (half of the real one)."""
    turn = np.exp(-1j * angle * np.arange(x.shape[1]))
    spectra, weight = (x * turn) @ v.T, v.sum(axis=1)
    at = spectra @ weight / (weight @ weight)
    rest = (np.abs(spectra - at[:, None] * weight) ** 2).sum(axis=1)
    return (len(v) - 1) * np.abs(at) ** 2 * (weight @ weight) / np.maximum(rest, 1e-300), at


def without_lines(x: np.ndarray, fs: float, freqs: list[float], bandwidth: float, p: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x without the sines that the test finds, and the F of each frequency as it was first; rows without any are the
    same numbers as before. Frequencies are tested one after the other on what is left, until none is found or rounds are over."""
    v = tapers_for(x.shape[1], fs, bandwidth)
    least, t, out = critical_f(len(v), p), np.arange(x.shape[1]), x.copy()
    first = np.array([sine_test(x, v, 2 * np.pi * f / fs)[0] for f in freqs]).T.reshape(len(x), len(freqs))
    live = np.arange(len(x))
    for _ in range(rounds):
        found = np.zeros(len(live), bool)
        for f in freqs:
            value, at = sine_test(out[live], v, 2 * np.pi * f / fs)
            hit = value > least
            out[live[hit]] -= 2 * np.real(at[hit, None] * np.exp(1j * 2 * np.pi * f / fs * t))
            found |= hit
        live = live[found]
        if not len(live):
            break
    return out, first


def windows(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, window, at, x): non-overlapping windows of `size` samples; what is left at the end belongs to the last. Null and
    missing values are not in the arrays."""
    n = samples.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("_n"))
    d = samples.filter("value IS NOT NULL").select(*keys, "sample_idx", F.col("value").cast("double").alias("value")).join(n, keys)
    window = F.least(F.floor(F.col("sample_idx") / size), F.greatest(F.lit(0).cast("long"), F.floor(F.col("_n") / size) - 1))
    g = d.groupBy(*keys, window.alias("window")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_x"))
    return g.select(*keys, "window", F.col("_x.sample_idx").alias("at"), F.col("_x.value").alias("x"))


def remove_tested_lines(samples: DataFrame, keys: list[str], *, fs: float, freqs: list[float], seconds: float = 4.0, bandwidth: float = 2.0, p: float = 0.01, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """samples -> (keys, sample_idx, cleaned) and the tests (keys, window, freq, f, critical).

    Each window of `seconds` loses the sines of those frequencies whose F is above what chance gives with probability p; a
    window without any keeps its values bit by bit. Null values stay out (missing in the result), the test takes a line
    between their neighbours for them. Windows of fewer than 8 values, or without any change, are left alone. A window is one
    row, so a recording is as many tasks as Spark likes.
    """

    def each(at: pd.Series, x: pd.Series):
        """Windows of equal length together: their numbers in the batch, the places of their values, the values."""
        by_length: dict[int, list[int]] = {}
        for i, a in enumerate(at):
            by_length.setdefault(int(a[-1] - a[0]) + 1, []).append(i)
        for length, rows in by_length.items():
            full = np.array([np.interp(np.arange(length), np.asarray(at[i]) - at[i][0], x[i]) for i in rows])
            yield length, rows, full

    @F.pandas_udf("struct<y: array<double>, f: array<double>, critical: double>")
    def clean(at: pd.Series, x: pd.Series) -> pd.DataFrame:
        y, f, least = list(x), [[float("nan")] * len(freqs) for _ in x], [float("nan")] * len(x)
        for length, rows, full in each(at, x):
            if length < 8:
                continue
            out, first = without_lines(full, fs, freqs, bandwidth, p, rounds)
            for i, r in enumerate(rows):
                f[r], least[r] = first[i], critical_f(len(tapers_for(length, fs, bandwidth)), p)
                if (out[i] != full[i]).any():
                    y[r] = out[i][np.asarray(at[r]) - at[r][0]]
        return pd.DataFrame({"y": y, "f": f, "critical": least})

    w = windows(samples, keys, max(8, int(round(seconds * fs)))).withColumn("_r", clean("at", "x"))
    cleaned = w.select(*keys, F.explode(F.arrays_zip("at", F.col("_r.y").alias("y"))).alias("_z")).select(*keys, F.col("_z.at").alias("sample_idx"), F.col("_z.y").alias("cleaned"))
    names = F.array(*[F.lit(float(f)) for f in freqs])
    tests = w.select(*keys, "window", F.explode(F.arrays_zip(names.alias("freq"), F.col("_r.f").alias("f"))).alias("_z"), "_r.critical").select(*keys, "window", F.col("_z.freq").alias("freq"), F.nanvl(F.col("_z.f"), F.lit(None)).alias("f"), F.nanvl("critical", F.lit(None)).alias("critical"))
    return cleaned, tests
