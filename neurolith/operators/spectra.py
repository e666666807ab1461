"""Spectra as rows: segments of a series are rows, their periodograms are averaged by an aggregate, and measures are queries.

A long recording is spread over tasks segment by segment; no task holds a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(samples: DataFrame, keys: list[str], columns: list[str], size: int, step: int) -> DataFrame:
    """(keys, segment, one array of `size` values for each column) of every full segment that begins each `step` samples.

    Samples are placed by sample_idx from 0; a segment with a missing sample or value is left out, so fill gaps before.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("sample_idx") - size + 1) / step))
    d = samples.select(*keys, "sample_idx", *columns).dropna(subset=columns)
    d = d.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("sample_idx") / step))))
    g = d.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("sample_idx", *columns))).alias("_x"))
    return g.filter(F.size("_x") == size).select(*keys, "segment", *[F.col(f"_x.{c}").alias(c) for c in columns])


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def _transformed(x: pd.Series, size: int) -> np.ndarray:
    x = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, size))
    return np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann(size), axis=1)


def _scale(size: int, fs: float) -> np.ndarray:
    """What makes squared bins a one-sided density."""
    out = np.full(size // 2 + 1, 2 / (fs * (hann(size) ** 2).sum()))
    out[0] /= 2
    if size % 2 == 0:
        out[-1] /= 2
    return out


def power_density(samples: DataFrame, keys: list[str], *, fs: float, size: int, step: int | None = None, value: str = "value") -> DataFrame:
    """Welch's density: (keys, bin, freq, power), the mean of the segments' periodograms (periodic Hann, means removed,
    segments that overlap by half unless step says otherwise). Series without a full segment have no rows."""
    scale = _scale(size, fs)

    @F.pandas_udf("array<double>")
    def periodogram(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(_transformed(x, size)) ** 2 * scale))

    s = segments(samples, keys, [value], size, step or size - size // 2)
    bins = s.select(*keys, F.posexplode(periodogram(value)).alias("bin", "p"))
    return bins.groupBy(*keys, "bin").agg(F.avg("p").alias("power")).withColumn("freq", F.col("bin") * F.lit(fs / size))


def cross_density(samples: DataFrame, keys: list[str], x: str, y: str, *, fs: float, size: int, step: int | None = None) -> DataFrame:
    """(keys, bin, freq, pxx, pyy, re, im) of two columns; coherence is (re^2 + im^2) / (pxx pyy), its imaginary part im / sqrt(pxx pyy)."""
    scale = _scale(size, fs)

    @F.pandas_udf("array<struct<pxx:double,pyy:double,re:double,im:double>>")
    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        fx, fy = _transformed(a, size), _transformed(b, size)
        c = np.conj(fx) * fy * scale
        parts = np.stack([np.abs(fx) ** 2 * scale, np.abs(fy) ** 2 * scale, c.real, c.imag], axis=2)
        return pd.Series([[dict(zip(("pxx", "pyy", "re", "im"), v, strict=True)) for v in row.tolist()] for row in parts])

    s = segments(samples, keys, [x, y], size, step or size - size // 2)
    bins = s.select(*keys, F.posexplode(both(x, y)).alias("bin", "p"))
    return bins.groupBy(*keys, "bin").agg(*[F.avg(f"p.{c}").alias(c) for c in ("pxx", "pyy", "re", "im")]).withColumn("freq", F.col("bin") * F.lit(fs / size))


# --- measures of a density -------------------------------------------------------------------------------------------


def area(low: float, high: float, *, closed: bool = True, power: str = "power") -> Column:
    """The trapezoid area of a density (one group's bins, evenly apart) over low <= freq <= high, or < high unless closed."""
    inside = (F.col("freq") >= low) & ((F.col("freq") <= high) if closed else (F.col("freq") < high))
    p, f = F.when(inside, F.col(power)), F.when(inside, F.col("freq"))
    ends = (F.min_by(p, f) + F.max_by(p, f)) / 2
    return F.when(F.count(p) > 1, (F.sum(p) - ends) * (F.max(f) - F.min(f)) / (F.count(p) - 1)).when(F.count(p) == 1, F.lit(0.0))


def summed(low: float, high: float, power: str = "power") -> Column:
    """The plain sum of the bins of low <= freq <= high."""
    return F.sum(F.when(F.col("freq").between(low, high), F.col(power)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


#: EEG bands in Hz, closed at both ends; relative power is that of 1 to 45 Hz.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45), "high_beta": (20, 30)}


def band_powers(density: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute and relative power of each band, theta / alpha and theta / (alpha + beta)."""
    g = density.groupBy(*keys).agg(area(1, 45).alias("total"), *[area(*b).alias(n) for n, b in BANDS.items()])
    rel = [ratio(F.col(n), F.col("total")).alias(f"{n}_rel") for n in BANDS]
    return g.select(*keys, "total", *BANDS, *rel, ratio(F.col("theta"), F.col("alpha")).alias("theta_alpha_ratio"), ratio(F.col("theta"), F.col("alpha") + F.col("beta")).alias("theta_alpha_beta_ratio"))


def quality_ratios(density: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """line_noise_ratio of 49-51 Hz to 45-49 and 51-55 Hz (null at 100 Hz and below), pulsatility of 0.8-2.5 Hz to 0.5-5 Hz and
    low_ratio of 1-4 Hz to 1-45 Hz, by areas that are open at the upper end."""
    a = lambda lo, hi: area(lo, hi, closed=False)
    line = ratio(a(49, 51), a(45, 49) + a(51, 55)) if fs > 100 else F.lit(None).cast("double")
    return density.groupBy(*keys).agg(line.alias("line_noise_ratio"), ratio(a(0.8, 2.5), a(0.5, 5)).alias("pulsatility"), ratio(a(1, 4), a(1, 45)).alias("low_ratio"))


def spectral_peaks(density: DataFrame, keys: list[str]) -> DataFrame:
    """The bins higher than both neighbours."""
    w = Window.partitionBy(*keys).orderBy("bin")
    d = density.withColumn("_a", F.lag("power").over(w)).withColumn("_b", F.lead("power").over(w))
    return d.filter((F.col("power") > F.col("_a")) & (F.col("power") > F.col("_b"))).drop("_a", "_b")


def dominant_frequencies(density: DataFrame, keys: list[str], *, most_freq: float, least_freq: float = 0.3, n: int = 5) -> DataFrame:
    """The n highest peaks of least_freq to most_freq, highest first: rank, freq (two places), power."""
    inside = density.filter(F.col("freq").between(least_freq, most_freq))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("power").desc(), "bin"))
    return spectral_peaks(inside, keys).withColumn("rank", rank).filter(F.col("rank") <= n).select(*keys, "rank", F.round("freq", 2).alias("freq"), "power")


def band_peak(density: DataFrame, keys: list[str], low: float, high: float, share: float = 0.1, least: float = 1e-12) -> DataFrame:
    """The highest peak within a band whose prominence is at least share of the band's largest power and `least`.

    A peak's prominence is its height over the higher of the least powers towards the next higher bin on either side. Bins
    of one band meet by their key, so the join is as small as the square of a band's bins.
    """
    band = density.filter(F.col("freq").between(low, high)).select(*keys, "bin", "freq", "power")
    top = spectral_peaks(band, keys)
    other = band.select(*keys, F.col("bin").alias("_b"), F.col("power").alias("_p"))
    left, right, over = F.col("_b") < F.col("bin"), F.col("_b") > F.col("bin"), F.col("_p") > F.col("power")
    d = top.join(other, keys)
    edge = d.groupBy(*keys, "bin", "freq", "power").agg(F.max("_p").alias("_most"), F.max(F.when(left & over, F.col("_b"))).alias("_l"), F.min(F.when(right & over, F.col("_b"))).alias("_r"))
    d = edge.join(other, keys)
    near_l, near_r = left & (F.col("_b") > F.coalesce("_l", F.lit(-1))), right & (F.col("_b") < F.coalesce("_r", F.lit(1 << 30)))
    d = d.groupBy(*keys, "bin", "freq", "power", "_most").agg(F.min(F.when(near_l, F.col("_p"))).alias("_a"), F.min(F.when(near_r, F.col("_p"))).alias("_c"))
    d = d.withColumn("prominence", F.col("power") - F.greatest("_a", "_c")).filter(F.col("prominence") >= F.greatest(share * F.col("_most"), F.lit(least)))
    best = F.max_by(F.struct("freq", "power", "prominence"), F.struct("power", -F.col("bin")))
    return d.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.freq").alias("peak_freq"), F.col("b.power").alias("peak_power"), F.col("b.prominence").alias("peak_prominence"))


def spectral_entropies(density: DataFrame, keys: list[str]) -> DataFrame:
    """Of the density as shares of its sum: renyi (order 2, bits) and shannon over the log of the bins, from 0 to 1."""
    d = density.withColumn("_q", F.col("power") / F.sum("power").over(Window.partitionBy(*keys)))
    shannon = -F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.log2("_q")).otherwise(0.0)) / F.log2(F.count(F.lit(1)))
    return d.groupBy(*keys).agg((-F.log2(F.sum(F.col("_q") * F.col("_q")))).alias("renyi_entropy"), shannon.alias("spectral_entropy"))


def spectral_outliers(density: DataFrame, recording: list[str], channel: str, *, low: float = 1.0, high: float = 100.0, z_low: float = -2.75, z_high: float = 2.75) -> DataFrame:
    """Channels of a recording whose mean log10 density of low to high Hz is z_low or z_high standard deviations from the others'."""
    m = density.filter(F.col("freq").between(low, high)).groupBy(*recording, channel).agg(F.avg(F.log10(F.greatest("power", F.lit(1e-30)))).alias("mean_log_power"))
    w = Window.partitionBy(*recording)
    z = (F.col("mean_log_power") - F.avg("mean_log_power").over(w)) / F.greatest(F.stddev_pop("mean_log_power").over(w), F.lit(1e-12))
    return m.withColumn("z", z).withColumn("spectral_outlier", (F.col("z") < z_low) | (F.col("z") > z_high))


def line_noise_outliers(density: DataFrame, recording: list[str], channel: str, *, line: float, width: float = 1.0, around: float = 5.0, most_z: float = 7.1) -> DataFrame:
    """Channels whose line noise (dB of the density within width of the line over that of the rest within around) lies most_z
    standard deviations over the recording's median."""
    far = F.abs(F.col("freq") - line)
    g = density.groupBy(*recording, channel).agg(F.avg(F.when(far <= width, F.col("power"))).alias("_l"), F.avg(F.when((far > width) & (far <= around), F.col("power"))).alias("_r"))
    g = g.withColumn("line_db", 10 * F.log10(F.greatest("_l", F.lit(1e-30)) / F.greatest("_r", F.lit(1e-30))))
    w = Window.partitionBy(*recording)
    z = (F.col("line_db") - F.median("line_db").over(w)) / F.greatest(F.stddev_pop("line_db").over(w), F.lit(1e-12))
    return g.select(*recording, channel, "line_db", z.alias("z")).withColumn("line_noise_outlier", F.col("z") > most_z)


def band_coherence(cross: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean coherence and mean absolute imaginary coherency of each band (closed ends)."""
    both = F.col("pxx") * F.col("pyy")
    coh = F.when(both > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / both)
    im = F.when(both > 0, F.abs(F.col("im")) / F.sqrt(both))
    at = lambda x, b: F.avg(F.when(F.col("freq").between(*b), x))
    return cross.groupBy(*keys).agg(*[at(coh, b).alias(f"coherence_{n}") for n, b in bands.items()], *[at(im, b).alias(f"imaginary_coherency_{n}") for n, b in bands.items()])


def cross_features(samples: DataFrame, keys: list[str], *, fs: float, size: int = 256, floor: float = 1e-8) -> DataFrame:
    """samples (keys, sample_idx, x, y) -> a row for each key that has both values anywhere: entropy_difference and entropy_sum
    (nats, of each channel's shares of its absolute values), alpha_asymmetry (y over x, natural log), engagement_index (beta
    over alpha and theta, both channels), coherence_alpha and coherence_beta.

    Bands are 4 to 7, 8 to 12 and 13 to 30 Hz, powers their plain sums over Welch's bins; without a full segment of `size`
    samples what needs bins is null. One aggregate over the samples, one over the bins.
    """
    both = samples.dropna(subset=["x", "y"])
    v = {c: F.abs(F.col(c)) + floor for c in "xy"}
    h = {c: F.log(F.sum(a)) - F.sum(a * F.log(a)) / F.sum(a) for c, a in v.items()}
    e = both.groupBy(*keys).agg((h["x"] - h["y"]).alias("entropy_difference"), (h["x"] + h["y"]).alias("entropy_sum"))
    cross = cross_density(both, keys, "x", "y", fs=fs, size=size)
    power = {(n, c): F.coalesce(summed(*b, f"p{c}{c}"), F.lit(0.0)) for n, b in {"theta": (4, 7), "alpha": (8, 12), "beta": (13, 30)}.items() for c in "xy"}
    asymmetry = F.log(power["alpha", "y"] + floor) - F.log(power["alpha", "x"] + floor)
    engagement = (power["beta", "x"] + power["beta", "y"]) / (power["alpha", "x"] + power["alpha", "y"] + power["theta", "x"] + power["theta", "y"] + floor)
    bands = cross.groupBy(*keys).agg(asymmetry.alias("alpha_asymmetry"), engagement.alias("engagement_index"))
    coherence = band_coherence(cross, keys, {"alpha": (8, 12), "beta": (13, 30)}).select(*keys, "coherence_alpha", "coherence_beta")
    return e.join(bands, keys, "left").join(coherence, keys, "left")


def nearest_bin(cross: DataFrame, keys: list[str], freqs: list[float], value: Column) -> DataFrame:
    """The value at the bin closest to each of freqs (the lower of ties): keys, target, freq, value."""
    d = cross.withColumn("_v", value).withColumn("target", F.explode(F.array(*[F.lit(float(f)) for f in freqs])))
    best = F.min_by(F.struct("freq", "_v"), F.struct(F.abs(F.col("freq") - F.col("target")), F.col("bin")))
    return d.groupBy(*keys, "target").agg(best.alias("b")).select(*keys, "target", F.col("b.freq").alias("freq"), F.col("b._v").alias("value"))


def line_frequencies(line: float, harmonics: list[float], neighbours: list[float]) -> list[float]:
    """The line, its double and the harmonics, each with its neighbours, without repeats, above 0, in order."""
    base = [line, 2 * line, *harmonics]
    return sorted({round(b + s * n, 9) for b in base for n in (0.0, *neighbours) for s in (1, -1) if b + s * n > 0})


def windowed_low_ratio(samples: DataFrame, keys: list[str], *, fs: float, size: int, step: int, low: tuple[float, float], total: tuple[float, float]) -> DataFrame:
    """The median over fixed windows of the share of low in total power: keys, low_freq_power_ratio, n_windows."""
    scale = _scale(size, fs)

    @F.pandas_udf("array<double>")
    def periodogram(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(_transformed(x, size)) ** 2 * scale))

    s = segments(samples, keys, ["value"], size, step).select(*keys, "segment", F.posexplode(periodogram("value")).alias("bin", "power"))
    s = s.withColumn("freq", F.col("bin") * F.lit(fs / size))
    each = s.groupBy(*keys, "segment").agg(ratio(area(*low), area(*total)).alias("r"))
    return each.groupBy(*keys).agg(F.median("r").alias("low_freq_power_ratio"), F.count("r").alias("n_windows"))
