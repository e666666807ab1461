"""Cleaning steps of more than one window against plain loops: heart beats, smooth thresholds, filters, rates, line noise."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurolith.operators import blocks as B
from neurolith.operators import cleaning as C
from neurolith.operators import heartbeats as H
from neurolith.operators import line_noise as L
from neurolith.operators import wavelets as V

KEYS = ["session_id", "signal"]


def table(spark, series: dict):
    rows = pd.concat([pd.DataFrame({"session_id": s, "signal": c, "sample_idx": np.arange(len(x)), "value": x}) for (s, c), x in series.items()])
    d = spark.createDataFrame(rows, "session_id string, signal string, sample_idx long, value double")
    return d.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


def column(d, session: str, channel: str, name: str) -> np.ndarray:
    return d.filter((F.col("session_id") == session) & (F.col("signal") == channel)).orderBy("sample_idx").toPandas()[name].to_numpy(float)


# --- heart beats -----------------------------------------------------------------------------------------------------


def beats_by_loop(x: np.ndarray, peaks: list[int], epoch: int, window: int) -> np.ndarray:
    x = x.copy()
    for start in range(0, len(x), epoch):
        stop = min(start + epoch, len(x))
        own = [p for p in sorted(set(peaks)) if start <= p < stop and p - window >= start and p + window <= stop and not np.isnan(x[p - window : p + window]).any()]
        if len(own) < 2:
            continue
        t = np.mean([x[p - window : p + window] for p in own], axis=0)
        for p in own:
            part = x[p - window : p + window]
            x[p - window : p + window] = part - (part @ t) / (t @ t + 1e-20) * t
    return x


def test_beats_are_taken_out_as_by_a_loop(spark):
    rng = np.random.default_rng(1)
    peaks = [20, 33, 46, 70, 82, 130, 145, 158, 171, 260]  # windows of 10 overlap, an epoch with one beat, one without
    series = {("a", "X"): rng.normal(size=350), ("a", "Y"): rng.normal(size=350) * 5, ("b", "X"): rng.normal(size=200)}
    series["a", "Y"][135] = np.nan
    p = spark.createDataFrame([("a", i // 100, i) for i in [*peaks, 33]], "session_id string, epoch long, peak long")
    got = H.remove_beats(table(spark, series), p, "session_id", "signal", epoch=100, window=10)
    for (s, c), x in series.items():
        assert np.allclose(column(got, s, c, "cleaned"), beats_by_loop(x, peaks if s == "a" else [], 100, 10), atol=1e-9, equal_nan=True)
    assert np.array_equal(column(got, "b", "X", "cleaned"), series["b", "X"])
    assert H.remove_beats(table(spark, series).limit(0), p, "session_id", "signal", epoch=100, window=10).count() == 0


def heart(seed: int, fs: float, seconds: int, beats: np.ndarray, gain: float) -> np.ndarray:
    rng, t = np.random.default_rng(seed), np.arange(int(fs * seconds)) / fs
    wave = lambda d: np.exp(-0.5 * (d / 0.012) ** 2) - 0.3 * np.exp(-0.5 * ((d - 0.05) / 0.03) ** 2)
    return rng.normal(size=len(t)) * 2 + gain * sum(wave(t - b) for b in beats)


def test_planted_beats_are_found_and_gone(spark):
    fs, beats = 100.0, np.arange(1.0, 59.5, 0.9) + np.random.default_rng(3).uniform(-0.05, 0.05, 66)[: len(np.arange(1.0, 59.5, 0.9))]
    beats = beats[beats < 29]  # the second epoch has none
    series = {("a", c): heart(i, fs, 60, beats, g) for i, (c, g) in enumerate((("X", 60.0), ("Y", 40.0)))}
    d = table(spark, series)
    p = H.epoch_peaks(d, "session_id", "signal", fs=fs, window_seconds=0.4, lowpass=45.0, peakiness=10.0).toPandas()
    assert set(p.epoch) == {0}
    assert all(np.abs(p.peak.to_numpy() / fs - b).min() < 0.03 for b in beats if 0.5 < b < 28)
    got = H.heartbeats_removed(d, "session_id", "signal", fs=fs, window_seconds=0.4, lowpass=45.0, peakiness=10.0)
    for c, g in (("X", 60.0), ("Y", 40.0)):
        x, y = series["a", c], column(got, "a", c, "cleaned")
        at = p.peak.to_numpy()
        assert np.abs(y[at]).mean() < 0.2 * np.abs(x[at]).mean()
        assert np.sum(y[at] ** 2) < 0.1 * np.sum(x[at] ** 2), g
        assert np.array_equal(x[3000:], y[3000:])
    own = H.epoch_peaks(d, "session_id", "signal", fs=fs, window_seconds=0.4, heart_channels=["X"]).filter("epoch = 0").toPandas()
    assert all(np.abs(own.peak.to_numpy() / fs - b).min() < 0.03 for b in beats if 0.5 < b < 28)


# --- smooth thresholds -----------------------------------------------------------------------------------------------


def smooth_by_loop(d: np.ndarray, block: int, hop: int, soft: bool) -> np.ndarray:
    n, half = len(d), block // 2
    centres = sorted({*range(0, n, hop), n - 1})
    at = []
    for c in centres:
        x = d[max(0, c - half) : min(n, c + half)]
        noise = np.median(np.abs(x)) / 0.6745
        at.append(noise**2 / np.sqrt(max(np.mean(x * x) - noise**2, 1e-12)))
    t = np.interp(np.arange(n), centres, at)
    return np.sign(d) * np.maximum(np.abs(d) - t, 0) if soft else np.where(np.abs(d) > t, d, 0)


@pytest.mark.parametrize(("n", "block", "hop"), [(101, 20, 5), (100, 21, 30), (7, 2, 1), (60, 40, 20), (1, 4, 2), (2, 4, 3)])
@pytest.mark.parametrize("soft", [True, False])
def test_smooth_thresholds_are_a_loop(spark, n, block, hop, soft):
    x = np.random.default_rng(n).normal(size=n) * np.where(np.arange(n) > n // 2, 5, 1)
    d = table(spark, {("a", "X"): x}).withColumn("n", F.lit(n))
    got = C.local_threshold(d, KEYS, "value", "sample_idx", n=F.col("n"), block=F.lit(block), hop=F.lit(hop), soft=soft)
    assert np.allclose(column(got, "a", "X", "shrunk"), smooth_by_loop(x, block, hop, soft), atol=1e-9)


def test_wavelets_with_smooth_thresholds(spark):
    rng = np.random.default_rng(2)
    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * 5 * t) + rng.normal(size=1000) * 0.3 + np.where((t > 6.4) & (t < 6.5), 40 * np.sin(2 * np.pi * 12 * t), 0)
    how = {"fs": 100.0, "wavelet": "bior4.4", "level": 4, "block_seconds": 1.0}
    d = table(spark, {("a", "X"): x})
    steps, lines = (column(V.wavelet_clean(d, KEYS, overlap=o, **how), "a", "X", "cleaned") for o in (0.0, 0.5))
    inside = (t > 6.4) & (t < 6.5)
    assert np.std(lines[inside]) < 0.5 * np.std(x[inside]) and len(lines) == 1000 and not np.allclose(steps, lines)
    short = V.wavelet_clean(table(spark, {("a", "X"): x[:40]}), KEYS, overlap=0.5, **how)
    assert short.count() == 40
    assert np.allclose(column(short, "a", "X", "cleaned"), column(V.wavelet_clean(table(spark, {("a", "X"): x[:40]}), KEYS, **how), "a", "X", "cleaned"))


# --- filters and rates by blocks -------------------------------------------------------------------------------------


def mirrored(x: np.ndarray, half: int) -> np.ndarray:
    n = len(x)
    at = lambda i: x[i] if 0 <= i < n else (2 * x[0] - x[-i] if -n < i < 0 else 2 * x[-1] - x[2 * (n - 1) - i] if n <= i <= 2 * (n - 1) else 0.0)
    return np.array([at(i) for i in range(-half, n + half)])


@pytest.mark.parametrize(("n", "block"), [(1000, 64), (1000, 1000), (999, 4096), (257, 64), (40, 64), (1, 64)])
def test_fir_is_a_plain_convolution_at_every_edge(spark, n, block):
    taps, x = B.band_pass_taps(100.0, 4.0, 30.0), np.random.default_rng(n).normal(size=n).cumsum()
    got = column(B.convolve(table(spark, {("a", "X"): x, ("b", "X"): x[: n // 2 + 1]}), KEYS, taps, block=block), "a", "X", "filtered")
    assert np.allclose(got, np.convolve(mirrored(x, len(taps) // 2), taps, "valid"), atol=1e-9)


def test_fir_bands(spark):
    t = np.arange(3000) / 250
    low, mid, high = (np.sin(2 * np.pi * f * t) for f in (0.0, 10.0, 60.0))
    d = table(spark, {("a", "X"): low + mid + high + 7})
    got = column(B.fir_band_pass(d, KEYS, fs=250.0, low=1.0, high=45.0, block=512), "a", "X", "filtered")
    assert np.abs(got - mid)[500:2500].max() < 0.01
    line = column(B.notch_band(d, KEYS, fs=250.0, freqs=[60.0, 120.0, 240.0], width=2.0), "a", "X", "filtered")
    assert np.abs(line - (low + mid + 7))[700:2300].max() < 0.02
    for taps in (B.band_pass_taps(250.0, 1.0, 45.0), B.band_pass_taps(250.0, None, 45.0), B.band_pass_taps(250.0, 1.0, None)):
        assert len(taps) % 2 == 1 and np.allclose(taps, taps[::-1])
    assert abs(B.band_pass_taps(250.0, None, 45.0).sum() - 1) < 1e-12 and abs(B.band_pass_taps(250.0, 1.0, None).sum()) < 1e-12


@pytest.mark.parametrize(("old", "new"), [(250, 100), (244, 100), (100, 250), (250, 250)])
def test_rates(spark, old, new):
    n = 2001
    t = np.arange(n) / old
    limit = min(old, new) / 2
    x = np.sin(2 * np.pi * 0.3 * limit * t) + 0.5 * np.cos(2 * np.pi * 0.8 * limit * t)
    above = np.sin(2 * np.pi * 1.15 * limit * t) if new < old else 0.0
    d = table(spark, {("a", "X"): x + above})
    got = column(B.resample(d, KEYS, old=old, new=new, block=300), "a", "X", "value")
    u = np.arange(round(n * new / old)) / new
    want = np.sin(2 * np.pi * 0.3 * limit * u) + 0.5 * np.cos(2 * np.pi * 0.8 * limit * u) + (0 if new != old else above)
    assert len(got) == len(u)
    inside = slice(len(u) // 8, -len(u) // 8)
    assert np.abs(got - want)[inside].max() < 1e-3
    one = column(B.resample(d, KEYS, old=old, new=new, block=100000), "a", "X", "value")
    assert np.allclose(got, one, atol=1e-9)


# --- line noise ------------------------------------------------------------------------------------------------------


def test_tapers_are_orthonormal_and_concentrated():
    for n in (50, 300, 1500):
        v = L.tapers(n, 4.0, 7)
        assert np.allclose(v @ v.T, np.eye(7), atol=2e-3 if n > 1024 else 1e-9)
        power = np.abs(np.fft.rfft(v, 64 * n, axis=1)) ** 2
        inside = power[:, : 64 * 4 + 1].sum(axis=1) / power.sum(axis=1)
        assert (inside[:5] > 0.99).all()
    rng = np.random.default_rng(0)
    v = L.tapers(256, 4.0, 7)
    f = L.sine_test(rng.normal(size=(4000, 256)), v, 0.9)[0]
    assert abs((f > L.critical_f(7, 0.05)).mean() - 0.05) < 0.012  # noise passes as often as it should


def test_lines_go_only_where_they_are(spark):
    fs, rng = 100.0, np.random.default_rng(4)
    t = np.arange(2100) / fs
    noise = rng.normal(size=2100)
    quiet = noise.copy()
    quiet[800:1200] += 6 * np.sin(2 * np.pi * 20 * t[800:1200] + 1.1)
    loud = noise + 3 * np.sin(2 * np.pi * 20 * t) + np.cos(2 * np.pi * 40 * t)
    loud[50:60] = np.nan
    d = table(spark, {("a", "X"): quiet, ("a", "Y"): loud, ("b", "X"): loud[:5]})
    cleaned, tests = L.remove_tested_lines(d, KEYS, fs=fs, freqs=[20.0, 40.0], seconds=4.0, p=1e-4)
    x, y = column(cleaned, "a", "X", "cleaned"), column(cleaned, "a", "Y", "cleaned")
    assert np.array_equal(np.delete(x, np.s_[800:1200]), np.delete(quiet, np.s_[800:1200]))  # bit by bit
    assert np.abs(x - noise)[800:1200].max() < 0.5
    assert len(y) == 2090 and np.abs(y - np.delete(noise, np.s_[50:60])).max() < 0.8
    found = {(r.session_id, r.signal, r.window, r.freq) for r in tests.filter("f > critical").collect()}
    assert found == {("a", "X", 2, 20.0), *(("a", "Y", w, f) for w in range(5) for f in (20.0, 40.0))}
    assert np.array_equal(column(cleaned, "b", "X", "cleaned"), loud[:5])
    assert L.remove_tested_lines(d.limit(0), KEYS, fs=fs, freqs=[20.0])[0].count() == 0


# --- entropy and dimension of bands ----------------------------------------------------------------------------------


def higuchi(x: np.ndarray, most: int = 10) -> float:
    n, lengths = len(x), []
    for s in range(1, min(most, n // 3) + 1):
        parts = []
        for m in range(s):
            r = (n - m - 1) // s
            parts.append(sum(abs(x[m + j * s] - x[m + (j - 1) * s]) for j in range(1, r)) * (n - 1) / (s * s * r))
        lengths.append(np.mean(parts))
    return np.polyfit(-np.log(np.arange(1, len(lengths) + 1)), np.log(lengths), 1)[0]


def test_entropy_and_dimension(spark):
    rng = np.random.default_rng(8)
    long, short, flat = rng.normal(size=700).cumsum(), rng.normal(size=35), np.ones(40)
    d = table(spark, {("a", "long"): long, ("a", "short"): short, ("a", "flat"): flat, ("a", "one"): np.ones(1)})
    h = {r.signal: r.higuchi_dimension for r in V.higuchi_dimension(d, KEYS, "sample_idx", "value").collect()}
    assert abs(h["long"] - higuchi(long)) < 1e-9 and abs(h["short"] - higuchi(short)) < 1e-9 and h["flat"] is None and h["one"] is None
    e = {r.signal: r.spectral_entropy for r in V.spectral_entropy(d, KEYS, "sample_idx", "value").collect()}
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    p = np.mean([np.abs(np.fft.rfft((long[i : i + 256] - long[i : i + 256].mean()) * window)) ** 2 for i in range(0, 700 - 255, 128)], axis=0)
    p[1:-1] *= 2
    p /= p.sum()
    assert abs(e["long"] + (p * np.log(p)).sum() / np.log(129)) < 1e-9 and e["flat"] is None and e["one"] is None and 0 < e["short"] < 1


@pytest.mark.parametrize(("before", "after"), [(2, 5), (0, 0), (-3, 9), (40, 30)])
def test_event_epochs_meet_by_blocks(spark, before, after):
    """The same epochs as by loops, at the recording's ends and about missing samples too; events meet samples by recording and block."""
    rng = np.random.default_rng(7)
    x = {s: rng.normal(size=n) for s, n in (("a", 150), ("b", 90))}
    x["a"][60] = np.nan
    tags = [("a", int(i), t) for i, t in zip(rng.integers(-10, 160, 60), rng.choice(["u", "v"], 60), strict=True)] + [("b", 45, "u"), ("b", 45, "v"), ("c", 5, "u")]
    d = table(spark, {(s, "X"): v for s, v in x.items()}).unionByName(table(spark, {("a", "Y"): x["a"] + 1}))
    got = C.event_epochs(d, spark.createDataFrame([(s, i, t) for s, i, t in sorted(set(tags))], "recording string, onset long, tag string").withColumnRenamed("recording", "session_id"), KEYS, before=before, after=after, offset=3)
    want = {}
    for (s, c), v in {("a", "X"): x["a"], ("b", "X"): x["b"], ("a", "Y"): x["a"] + 1}.items():
        for r, i, t in set(tags):
            part = v[i + 3 - before : i + 3 + after + 1] if r == s and i + 3 - before >= 0 and i + 3 + after < len(v) else [np.nan]
            if not np.isnan(part).any():
                want[s, c, t, i + 3] = list(part)
    assert want and {(r.session_id, r.signal, r.tag, r.onset): list(r.epoch) for r in got.collect()} == want
    joins = re.findall(r"Join \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert joins and all("," in j for j in joins)
