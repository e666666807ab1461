"""Measures of raw signals: coupling, beats, windows and the way to the session's decision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from neurolith.operators import kernels as K
from neurolith.operators import measures as M
from neurolith.operators import session as D

KEYS = ["session_id", "signal"]


def table(spark, series: dict):
    rows = pd.concat([pd.DataFrame({"session_id": s, "signal": c, "sample_idx": np.arange(len(x)), "value": np.asarray(x, float)}) for (s, c), x in series.items()])
    d = spark.createDataFrame(rows, "session_id string, signal string, sample_idx long, value double")
    return d.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def pulse(t: np.ndarray, beats: np.ndarray) -> np.ndarray:
    return sum(np.exp(-0.5 * ((t - b) / 0.08) ** 2) for b in beats)


def session(seed: int, good: bool, seconds: int = 60) -> dict:
    rng, t, o = np.random.default_rng(seed), np.arange(244 * seconds) / 244, np.arange(100 * seconds) / 100
    beats = np.arange(0.5, seconds, 0.85) + rng.uniform(-0.03, 0.03, len(np.arange(0.5, seconds, 0.85)))
    shared = rng.normal(size=len(t)).cumsum()
    shared -= np.linspace(shared[0], shared[-1], len(t))
    eeg = lambda: 10 * np.sin(2 * np.pi * 10 * t) + shared * 0.5 + rng.normal(0, 3, len(t))
    wave = pulse(o, beats)
    out = {"AF3": eeg(), "AF4": eeg(), "PPG": 2000 + 400 * (wave if good else 0) + rng.normal(0, 3, len(o))}
    out["fNIRS_1"], out["fNIRS_2"] = (1000 + 10 * (wave if good else 0) + rng.normal(0, 1, len(o)) for _ in range(2))
    return out


def test_the_way_from_raw_signals_to_a_decision(spark):
    d = table(spark, {(s, c): x for s, good in (("good", True), ("weak", False)) for c, x in session(3, good).items()})
    filtered, beats, windows = M.session_windows(d, eeg_fs=244.0, optical_fs=100.0, seconds=2.0)
    assert filtered.count() == d.count() and windows.filter("signal = 'PPG' AND session_id = 'good'").count() == 30
    m = {(r.session_id, r.signal): r for r in M.signal_measures(d, filtered, beats, windows, eeg_fs=244.0, optical_fs=100.0).collect()}
    assert len(m) == 10
    good, weak = m["good", "PPG"], m["weak", "PPG"]
    assert abs(good.median_hr_bpm - 60 / 0.85) < 1.5 and good.valid_ibi_percent > 98 and weak.valid_ibi_percent < good.valid_ibi_percent
    assert m["good", "fNIRS_1"].coupling_index > 0.9 and abs(m["weak", "fNIRS_1"].coupling_index) < 0.3
    raw = session(3, True)
    a, b = (K.band_filter(raw[c], 100.0, 0.8, 2.5, 3) for c in ("fNIRS_1", "fNIRS_2"))
    assert abs(m["good", "fNIRS_2"].coupling_index - np.corrcoef(a, b)[0, 1]) < 1e-9
    a, b = (K.chain_filter(raw[c], 244.0, "eeg") for c in ("AF3", "AF4"))
    assert abs(m["good", "AF3"].channel_correlation - np.corrcoef(a, b)[0, 1]) < 1e-9 and m["good", "PPG"].channel_correlation is None
    f, p = K.welch(a, 244.0, 976)
    area = lambda lo, hi: np.trapezoid(p[(f >= lo) & (f < hi)], f[(f >= lo) & (f < hi)])
    assert abs(m["good", "AF3"].low_ratio - area(1, 4) / area(1, 45)) < 1e-6
    labels = D.signal_decisions(M.signal_measures(d, filtered, beats, windows, eeg_fs=244.0, optical_fs=100.0), F.col("modality"))
    got = {(r.session_id, r.signal): r.label for r in labels.collect()}
    assert got["good", "PPG"] == "PASS" and got["weak", "fNIRS_1"] == "FAIL" and got["good", "fNIRS_1"] == "PASS"


def test_pulse_windows_carry_intervals_over(spark):
    x = {("a", "PPG"): np.sin(np.arange(400) / 3.0)}
    at = [10, 60, 95, 105, 190, 250, 260]
    beats = spark.createDataFrame([("a", "PPG", i) for i in at], "session_id string, signal string, peak_idx long")
    got = {r.window_index: r for r in M.pulse_windows(table(spark, x), beats, fs=100.0, size=100).collect()}
    assert [got[w].n_peaks for w in range(4)] == [3, 2, 2, 0]
    assert got[0].valid_ibi_percent == 50.0  # 0.5 s is valid, 0.35 s is not; the first beat has none before it
    assert got[1].valid_ibi_percent == 0.0 and "implausible_peak_count" in got[3].artifact_reason and not got[0].artifact
    one = M.pulse_measures(beats.filter("peak_idx < 50"), fs=100.0).first()
    assert one.n_peaks == 1 and one.valid_ibi_percent == 0.0 and one.median_hr_bpm is None


def test_optical_windows_see_steps_and_gaps(spark):
    raw = 100 + np.random.default_rng(1).normal(size=400)
    raw[150:155], raw[270:] = np.nan, raw[270:] + 40
    raw[300:400] = np.nan
    d = table(spark, {("a", "fNIRS_1"): raw}).withColumn("filtered", F.sin(F.col("sample_idx") / 7))
    got = {r.window_index: r for r in M.optical_windows(d, size=50).collect()}
    assert len(got) == 8 and "motion_step" in got[5].artifact_reason and "high_local_cv" in got[5].artifact_reason
    part = raw[150:200][5:]
    assert abs(got[3].raw_mean - part.mean()) < 1e-9 and abs(got[3].max_first_difference - np.abs(np.diff(part)).max()) < 1e-9
    assert got[7].raw_mean is None and got[7].max_first_difference == 0.0 and M.optical_windows(d.limit(0), size=50).count() == 0
