"""Golden cases of the operators, kernels against closed forms, sources as round trips, queries against their SQL."""

from __future__ import annotations

import base64
import json
import os
import time
from ast import literal_eval

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurolith.operators import cleaning as C
from neurolith.operators import epochs as E
from neurolith.operators import features as X
from neurolith.operators import kernels as K
from neurolith.operators import session as D
from neurolith.operators import signal as S
from neurolith.operators import spectra as P
from neurolith.operators import study as T
from neurolith.operators import tables as B
from neurolith.operators import wavelets as V
from neurolith.plans import registry
from neurolith.sources import recordings as R

registry.load()
SF = "/root/testdata/sf0.001"


def series(spark, values, signal="A"):
    return spark.createDataFrame([(1, signal, i, None if v is None else float(v)) for i, v in enumerate(values)], "session_id long, signal string, sample_idx long, value double")


def test_block_split(spark):
    d = spark.createDataFrame([(1, t) for t in (0, 1000, 3500, 6001)], "k long, t long")
    assert [r.block_id for r in S.split_blocks(d, ("k",), "t", 2500).orderBy("t").collect()] == [0, 0, 0, 1]


def test_merge_intervals(spark):
    d = spark.createDataFrame([(1, "A", i, i != 2, "x;b" if i == 1 else "a") for i in range(4)], "session_id long, signal string, window_index long, artifact boolean, artifact_reason string")
    got = sorted((r.start_window, r.end_window, r.reason) for r in S.merge_intervals(d).collect())
    assert got == [(0, 2, "a;b;x"), (3, 4, "a")]


def test_flatline_and_clipping(spark):
    assert S.longest_flatline(series(spark, [1, 1, 1, 2]), 1.0).first().longest_flatline_seconds == 3.0
    assert S.longest_flatline(series(spark, [1, 2, 3]), 1.0).first().longest_flatline_seconds == 0.0
    assert S.clipping_percent(series(spark, [0, 1, 2, 2])).first().clipping_percent == 75.0
    assert S.clipping_percent(series(spark, [5, 5])).first().clipping_percent == 100.0


def test_fill_and_smooth(spark):
    filled = [r.filled for r in S.fill_linear(series(spark, [None, 1, None, 3, None])).orderBy("sample_idx").collect()]
    assert filled == [1, 1, 2, 3, 3]
    assert [r.filled for r in S.fill_linear(series(spark, [None, None])).collect()] == [0, 0]
    smooth = [r.smoothed for r in S.moving_mean(series(spark, [1] * 5)).orderBy("sample_idx").collect()]
    assert np.allclose(smooth, [2 / 3, 1, 1, 1, 2 / 3])


def test_onset_and_runs(spark):
    base = spark.createDataFrame([(1, "A", 0.9)], "session_id long, signal string, baseline double")
    assert S.sustained_onset(series(spark, [0, 0, 1, 1, 1, 1, 1, 1]), base, 3, 2.0).first().onset_idx == 3
    got = S.longest_above(series(spark, [9, 9, 9, 0, 0, 0, 9, 9, 9]), base, 2.0, 2.0).first()
    assert (got.longest_start, got.longest_seconds) == (0, 8.0)


def test_robust_z_without_spread(spark):
    z = [r.z for r in S.with_robust_z(series(spark, [1, 1, 1, 5]), "value", "z").orderBy("sample_idx").collect()]
    assert z[3] > 1 and z[0] == 0 and [r.z for r in S.with_robust_z(series(spark, [2, 2]), "value", "z").collect()] == [0, 0]


def test_thirds_and_windows(spark):
    d = spark.createDataFrame([(0, 100)], "a long, b long")
    assert [(r.part_start, r.part_stop) for r in X.thirds(d, "a", "b").orderBy("part").collect()] == [(0, 33), (33, 67), (67, 100)]
    w = spark.createDataFrame([(0.0, 250.0), (0.0, 100.0)], "start_s double, stop_s double")
    assert [(r.from_s, r.to_s) for r in X.anchored_windows(w, 120.0).orderBy("from_s").collect()] == [(0, 120), (120, 240), (240, 250)]


def test_final_label_order(spark):
    d = spark.createDataFrame([(None, "FAIL", "x;longest_continuous_block_below_minimum"), (False, "PASS", ""), (True, None, None), (True, "FAIL", None), (True, "ODD", "")], "e boolean, o string, r string")
    assert [r[0] for r in d.select(T.final_label(F.col("e"), F.col("o"), F.col("r"))).collect()] == ["EXCLUDED_L2_DURATION", "EXCLUDED_L1", "L2_NOT_RUN", "EXCLUDED_L2_SIGNAL", "UNKNOWN"]


def test_butterworth_gain():
    for order, edges, kind in ((3, [8.0], "low"), (2, [8.0], "high"), (4, [5.0, 15.0], "band"), (3, [0.5, 8.0], "band")):
        s = K.butter_sections(order, edges, kind, 100.0)
        gain = lambda f, s=s: abs(np.prod([np.polyval(x[:3], z := np.exp(2j * np.pi * f / 100)) / np.polyval(x[3:], z) for x in s]))
        assert all(abs(gain(f) - np.sqrt(0.5)) < 1e-6 for f in edges), (order, kind)
        inside = {"low": 0.01, "high": 40.0, "band": np.sqrt(edges[0] * edges[-1])}[kind]
        assert abs(gain(inside) - 1) < 0.02 and gain({"low": 40.0, "high": 0.5, "band": 45.0}[kind]) < 0.05


def test_zero_phase_keeps_a_tone():
    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * 3 * t)
    y = K.band_filter(x + 5 + 0.3 * t, 100.0, 0.5, 8.0, 3)
    assert np.abs(y - x)[200:-200].max() < 0.05


def test_welch_of_a_tone():
    t = np.arange(2000) / 100
    f, p = K.welch(np.sin(2 * np.pi * 10 * t), 100.0, 400)
    assert abs(f[p.argmax()] - 10) < 1e-9 and abs(np.trapezoid(p, f) - 0.5) < 0.01


def test_tddr_removes_a_step():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.002, 12_000)
    x[6000:] += 0.03
    y = K.biweight_derivative(x, 100.0)
    assert abs(y[6500:].mean() - y[:5500].mean()) < 0.1 * 0.03


def test_peaks_and_random_intercept(spark):
    t = np.arange(3000) / 100
    assert len(K.peaks(np.sin(2 * np.pi * 1.2 * t), 35)) == 36
    rng = np.random.default_rng(1)
    u = rng.normal(0, 3, 60)
    rows = [(g, float(x), float(2 + 1.5 * x + u[g] + e)) for g in range(60) for x, e in zip(rng.normal(size=20), rng.normal(size=20), strict=True)]
    r = K.random_intercept(spark.createDataFrame(rows, "g long, x double, y double"), "g", "x", "y").first()
    sd = float(np.std([x for _, x, _ in rows]))
    assert abs(r.slope / sd - 1.5) < 0.1 and r.p < 1e-6 and abs(r.icc - r.group_variance / (r.group_variance + r.residual_variance)) < 1e-9 and abs(r.residual_variance - 1) < 0.15 and 4 < r.group_variance < 16


def restricted_likelihood(rows: list, r: float) -> float:
    """Up to a constant, from the definition: with the covariance matrix of all rows."""
    g, x, y = (np.array(c) for c in zip(*rows, strict=True))
    x = (x - x.mean()) / x.std()
    v = np.eye(len(y)) + r * (g[:, None] == g)
    m = np.stack([np.ones(len(y)), x], axis=1)
    w = np.linalg.inv(v)
    b = np.linalg.solve(m.T @ w @ m, m.T @ w @ y)
    e = y - m @ b
    return -0.5 * ((len(y) - 2) * np.log(e @ w @ e) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(m.T @ w @ m)[1])


def test_random_intercept_is_restricted_likelihood(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(0, 0.7, 12)
    rows = [(int(g), float(x), float(x + u[g] + rng.normal())) for g, x in zip(rng.integers(0, 12, 80), rng.normal(size=80), strict=True)]
    got = K.random_intercept(spark.createDataFrame(rows, "g long, x double, y double"), "g", "x", "y").first()
    at = got.group_variance / got.residual_variance
    best = restricted_likelihood(rows, at)
    assert all(restricted_likelihood(rows, r) <= best + 1e-6 for r in [0, *np.logspace(-3, 2, 60), at * 1.05, at / 1.05])
    assert K.random_intercept(spark.createDataFrame([(1, 1.0, 2.0)], "g long, x double, y double"), "g", "x", "y").first().slope is None
    both = K.batch_random_intercepts(spark.createDataFrame(rows, "g long, x double, y double"), "g", [("x", "y"), ("y", "x")]).collect()
    assert len(both) == 2 and all(r.q >= r.p for r in both)
    from math import erfc

    z = spark.createDataFrame([(float(v),) for v in (0, 0.5, 1.96, 4.0)], "z double")
    assert all(abs(r.p - erfc(abs(r.z) / 2**0.5)) < 2e-7 for r in z.select("z", K.two_sided_normal(K.F.col("z")).alias("p")).collect())


def test_block_recursion_is_the_recursion():
    rng = np.random.default_rng(4)
    for n in (1, 5, 255, 256, 257, 1000):
        x = rng.normal(size=n)
        for s in (K.butter_sections(3, [0.2], "low", 10.0), K.butter_sections(4, [0.5, 4.0], "band", 25.0)):
            want = x
            for b0, b1, b2, _, a1, a2 in s:
                level = (b0 + b1 + b2) / (1 + a1 + a2)
                s2 = (b2 - a2 * level) * want[0]
                s1, out = (b1 - a1 * level) * want[0] + s2, []
                for v in want:
                    out.append(b0 * v + s1)
                    s1, s2 = b1 * v - a1 * out[-1] + s2, b2 * v - a2 * out[-1]
                want = np.array(out)
            assert np.allclose(K._run(s, x), want, atol=1e-9)


def test_notch_and_peaks():
    t = np.arange(4000) / 250
    x = np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 10 * t)
    y = K.notch(x, 250.0)[500:-500]
    assert np.abs(y - np.sin(2 * np.pi * 10 * t)[500:-500]).max() < 0.02
    assert K.peaks(np.array([0.0, 1, 1, 2, 0]), 1).tolist() == [3]
    assert K.peaks(np.array([0.0, 1, 1, 1, 0, 3, 0]), 1).tolist() == [2, 5]
    assert K.peaks(np.array([0.0, 1, 0, 3, 0, 2, 0]), 3).tolist() == [3] and K.peaks(np.array([0.0, 2, 1.5, 3, 0]), 1, 1.0).tolist() == [3]


def test_long_gap_fill(spark):
    d = spark.range(200_000).selectExpr("1 AS session_id", "'A' AS signal", "id AS sample_idx", "CASE WHEN id % 10 = 5 THEN CAST(id AS DOUBLE) END AS value")
    began = time.time()
    r = S.fill_linear(d).agg({"filled": "sum"}).first()[0]
    assert time.time() - began < 30 and abs(r - (sum(range(5, 199_996)) + 5 * 5 + 4 * 199_995)) < 1e-3


def test_edf_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {"AF3": rng.normal(0, 50, 1000), "AF4": np.full(1000, 3.0)}
    data = R.encode_edf(x, 100)
    signals, rates = R.decode_edf(data)
    assert rates == {"AF3": 100.0, "AF4": 100.0} and all(np.abs(signals[k] - x[k]).max() < 0.05 for k in x)
    (tmp_path / "a.edf").write_bytes(data)
    (tmp_path / "b.edf").write_bytes(b"nothing")
    got = R.read_edf(spark, str(tmp_path))
    assert got.filter("error IS NULL").count() == 2000 and got.filter("error IS NOT NULL").count() == 1
    assert R.file_hashes(spark, str(tmp_path), "*.edf").count() == 2


def test_device_csv(spark, tmp_path):
    folder = tmp_path / "participant=P_A1" / "study_day=03" / "session_id=abc"
    folder.mkdir(parents=True)
    (folder / "raw.csv").write_text("timestamp,AF_3,AF_4,PPG,Fnir_1,Fnir_2\n" + "".join(f"{i},{i},x,1,2,NaN\n" for i in range(500)))
    d = R.read_device_csv(spark, str(tmp_path))
    row = d.filter("row_idx = 300").first()
    assert (row.participant_key, row.study_day, row.session_id, row.packet_id, row.af3, row.af4, row.fnirs_2) == ("P_A1", 3, "abc", 1, 300.0, None, None)
    assert R.unpack_optical(d, ["file"]).agg(F.count("*"), F.max("sample_idx")).first()[:] == (200, 199)
    with pytest.raises(ValueError, match="ppg"):
        R.resolve_columns(["timestamp", "AF3", "AF4"])


def test_optical_unpack_numbers_rows_in_ranges(spark, tmp_path, capsys):
    from neurolith.plans.study import optical_unpack

    rows = [((i * 7919) % 1009, 1 + i % 7, i % 11, i % 5, float(i), float(i % 50), f"2024-01-{1 + i % 28:02d}", "RAN"[i % 3]) for i in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate string, l_returnflag string").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = optical_unpack(spark, str(tmp_path))
    kept = sorted(rows)
    want = {(i, i // 244 * 100 + i % 244, r[4]) for i, r in enumerate(kept) if i % 244 < 100 and i // 244 < len(kept) // 244}
    assert {tuple(r) for r in d.collect()} == want and d.count() == len(want)
    d.explain()
    assert "Window" not in capsys.readouterr().out


def test_quality_flags(spark):
    d = spark.createDataFrame([(600.0, 5.0), (1200.0, 50.0), (None, None), (900.0, 50.0)], "File_Length_s double, Pct_Var_Retained_PostWavelet double")
    got = [r.eeg_quality_flags for r in R.quality_flags(d).collect()]
    assert got == ["TRUNCATED_RECORDING;LOW_VARIANCE_RETAINED", "ANOMALOUS_LONG_RECORDING", "", ""]


def test_align_events(spark):
    d = spark.createDataFrame([(1, 0, -5, 50, 0), (1, 1, 40, 90, 1), (1, 2, 120, 150, 0)], "session_id long, event_order long, start_idx long, stop_idx long, phase_rank int")
    got = [(r.start_idx, r.stop_idx, r.flags) for r in X.align_events(d, 100).orderBy("event_order").collect()]
    assert got == [(0, 50, "EVENT_CLIPPED"), (40, 90, "EVENT_OVERLAP"), (100, 100, "EVENT_CLIPPED;EVENT_OUT_OF_RANGE;EVENT_ORDER")]


def test_sidecar(spark):
    got = json.loads(R.sidecar(series(spark, [1, 2, 3]), "session_id", 10.0).first().json)
    assert np.frombuffer(base64.b64decode(got["channels"]["A"]), np.float32).tolist() == [1, 2, 3] and got["n_samples"] == 3


def test_stream(spark, tmp_path):
    from neurolith.streaming.quality import window_quality

    spark.sql("SELECT 1L AS session_id, 'A' AS signal, timestamp_seconds(id) AS ts, CAST(id * 30 AS DOUBLE) AS value FROM range(20)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id long, signal string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    q = window_quality(stream).writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("live").collect()
    assert got and all(r.n == 2 for r in got) and any(r.artifact for r in got) and not all(r.artifact for r in got)


def epoch_rows(spark, rows):
    return spark.createDataFrame([(1, e, c, [float(x) for x in a]) for e, c, a in rows], "session_id long, epoch long, channel long, a array<double>")


def test_joint_probability(spark):
    d = epoch_rows(spark, [(i, 0, [50.0 if i == 9 else 1.0 + i % 2] * 4) for i in range(10)])
    assert [r.epoch for r in E.joint_probability(d, "session_id", 2.0).filter("rejected").collect()] == [9]
    same = E.joint_probability(epoch_rows(spark, [(i, 0, [1, 1]) for i in range(3)]), "session_id", 2.0)
    assert [(r.surprisal, r.rejected) for r in same.collect()] == [(0.0, False)] * 3


def test_channel_properties(spark):
    x = np.random.default_rng(3).normal(0, 1, 64)
    got = {r.channel: r for r in E.channel_properties(epoch_rows(spark, [(0, 0, x), (0, 1, -2 * x), (0, 2, np.ones(64))]), "session_id").collect()}
    z = np.cumsum(x - x.mean())
    assert np.isclose(got[0].hurst, np.log((z.max() - z.min()) / x.std()) / np.log(64)) and got[2].hurst == 0.5
    assert np.isclose(got[0].mean_correlation, 1) and got[2].mean_correlation is None
    assert np.isclose(got[1].variance, 4 * x.var()) and np.isclose(got[0].max_gradient, np.abs(np.diff(x)).max())


def test_bad_channels(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(3):
        x = rng.normal(0, 1, 200)
        rows += [(e, 0, x), (e, 1, x + rng.normal(0, 0.1, 200)), (e, 2, rng.normal(0, 1, 200)), (e, 3, np.full(200, 2.0))]
    got = {r.channel: (r.flat, r.uncorrelated) for r in E.bad_channels(epoch_rows(spark, rows), "session_id", 0.485).collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, True), 3: (True, True)}
    assert E.bad_channels(epoch_rows(spark, [(0, 0, [1, 2, 3])]), "session_id", 0.4).first().uncorrelated


def test_step_quality(spark):
    x = np.random.default_rng(5).normal(0, 1, 64)
    d = epoch_rows(spark, [(0, 0, x), (1, 0, x[::-1])]).withColumnRenamed("a", "pre")
    same = E.step_quality(d.withColumn("post", F.col("pre")), "session_id").first()
    assert np.isclose(same.cross_correlation, 1) and (same.rmse, same.mae, same.snr_db, same.peak_snr_db) == (0, 0, None, None)
    half = d.withColumn("post", F.transform("pre", lambda v: v / 2))
    assert np.isclose(E.step_quality(half, "session_id").first().snr_db, 0)
    assert np.allclose([r.coherence for r in E.step_coherence(half, "session_id", 64, [3, 9]).collect()], 1)


def test_tachogram_power(spark):
    t = np.cumsum(np.full(200, 0.8))
    beats = spark.createDataFrame([(1, float(v), float(0.8 + 0.05 * np.sin(2 * np.pi * 0.1 * v))) for v in t] + [(2, 1.0, 0.8), (2, 2.0, 0.8)], "k long, t double, ibi double")
    got = {r.k: r for r in K.tachogram_power(beats, "k", "t").collect()}
    assert got[1].lf_hf_ratio > 20 and np.isclose(got[1].lf_power, 50**2 / 2, rtol=0.1)
    assert (got[2].lf_power, got[2].lf_hf_ratio, got[2].seconds) == (None, None, 1.0)


def test_signal_rules(spark):
    rows = [(1, "EEG", 3.0, 0.0, 0.0, 0.0, None, None), (2, "EEG", 0.0, 0.0, 0.0, 31.0, None, None), (3, "EEG", 0.0, 0.0, 0.0, 11.0, None, None), (4, "EEG", None, None, None, None, None, None), (5, "PPG", 0.0, 0.0, 0.0, 0.0, 200.0, None), (6, "PPG", 0.0, 0.0, 0.0, 0.0, 70.0, None), (7, "fNIRS", 0.0, 0.0, 0.0, 31.0, None, 0.4), (8, "fNIRS", 3.0, 0.0, 0.0, 31.0, None, 0.4), (9, "fNIRS", 0.0, 0.0, 0.0, 0.0, None, 0.6)]
    d = spark.createDataFrame(rows, "id long, modality string, missing_percent double, clipping_percent double, flatline_seconds double, artifact_percent double, median_hr_bpm double, coupling_index double")
    got = {r.id: (r.label, r.reasons) for r in D.signal_decisions(d, F.col("modality")).collect()}
    assert got == {1: ("FAIL", "structural_signal_failure"), 2: ("FAIL", "severe_recurrent_artifact"), 3: ("CONDITIONAL_PASS", "moderate_artifact_burden"), 4: ("PASS", "acceptable_qc_metrics"), 5: ("FAIL", "implausible_median_heart_rate"), 6: ("PASS", "stable_pulse_waveform"), 7: ("FAIL", "poor_scalp_coupling"), 8: ("FAIL", "structural_signal_failure"), 9: ("CONDITIONAL_PASS", "marginal_scalp_coupling")}


def test_session_rules(spark):
    signals = spark.createDataFrame([(i, s, "PASS") for i in (1, 2, 3, 4) for s in ("AF3", "AF4", "PPG", "fNIRS_1", "fNIRS_2")] + [(5, "PPG", "PASS"), (6, "AF3", "FAIL"), (6, "AF4", "PASS"), (6, "PPG", "FAIL")], "session_id long, signal string, label string")
    recordings = spark.createDataFrame([(1, 900.0, 0, 0, 0.0, 1.0), (2, 800.0, 2, 0, 0.0, 1.0), (3, 900.0, 0, 3, 0.0, 11.0), (4, 900.0, 0, 0, 0.0, 11.0), (5, 900.0, 0, 0, 0.0, None), (6, 900.0, 0, 0, 50.0, 1.0), (7, 900.0, 0, 0, None, None)], "session_id long, duration_seconds double, long_intervals long, duplicates long, global_artifact_percent double, rms_ratio double")
    got = {r.session_id: (r.overall_session_label, r.reasons) for r in D.session_decisions(signals, recordings).collect()}
    part = "usable_after_cleaning_or_partial_modality_limit"
    assert got == {1: ("PASS", "all_primary_qc_layers_passed"), 2: ("FAIL", "longest_continuous_block_below_minimum;packet_gaps_detected"), 3: ("CONDITIONAL_PASS", f"duplicate_packet_timestamps;{part};large_eeg_channel_imbalance"), 4: ("CONDITIONAL_PASS", "all_primary_qc_layers_passed;large_eeg_channel_imbalance"), 5: ("CONDITIONAL_PASS", part), 6: ("FAIL", "eeg_and_ppg_failed"), 7: ("FAIL", "severe_multimodal_artifact")}


def test_spectra_of_a_tone(spark):
    t = np.arange(2048) / 128
    d = series(spark, np.sin(2 * np.pi * 10 * t) + 0.2 * np.sin(2 * np.pi * 50 * t))
    p = P.power_density(d, ["session_id", "signal"], fs=128.0, size=256)
    f, want = K.welch(np.sin(2 * np.pi * 10 * t) + 0.2 * np.sin(2 * np.pi * 50 * t), 128.0, 256)
    assert np.allclose([r.power for r in p.orderBy("bin").collect()], want, atol=1e-9)
    b = P.band_powers(p, ["session_id", "signal"]).first()
    assert b.alpha_rel > 0.9 and abs(b.total - 0.5) < 0.02
    assert P.band_peak(p, ["signal"], 8, 12).first().peak_freq == 10
    assert [r.freq for r in P.dominant_frequencies(p, ["signal"], most_freq=60).orderBy("rank").collect()][:2] == [10, 50]
    q = P.quality_ratios(p, ["signal"], 128.0).first()
    assert q.line_noise_ratio > 5
    assert P.line_frequencies(50.0, [150.0], [2.0]) == [48, 50, 52, 98, 100, 102, 148, 150, 152]


def test_rank_correlation_p(spark):
    known = [(0.5, 10, 0.14111328), (0.9, 5, 0.03738607), (0.0, 8, 1.0), (1.0, 6, 0.0)]  # from Student's t tables
    d = spark.createDataFrame([(r, n) for r, n, _ in known] + [(None, 5), (0.5, 2)], "rho double, n long")
    got = [r.p for r in d.select(B.spearman_p(F.col("rho"), F.col("n")).alias("p")).collect()]
    assert all(abs(g - w) < 1e-6 for g, (_, _, w) in zip(got, known, strict=False)) and got[4] is None and got[5] is None


def test_line_is_removed(spark):
    t = np.arange(2440) / 244
    d = series(spark, np.sin(2 * np.pi * 50 * t + 0.3) + np.sin(2 * np.pi * 9 * t))
    got = np.array([r.cleaned for r in C.remove_line(d, ["session_id", "signal"], fs=244.0, freqs=[50.0]).orderBy("sample_idx").collect()])
    assert np.abs(got - np.sin(2 * np.pi * 9 * t)).max() < 0.05
    for n, block in ((103, 25), (7, 40), (100, 25)):
        want = np.repeat(np.arange(k := max(1, round(n / block))), [len(x) for x in np.array_split(np.arange(n), k)])
        got = spark.range(n).select(C.block_of(F.col("id"), F.lit(n), block).alias("b")).collect()
        assert [r.b for r in got] == want.tolist()


def test_optional_tables(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,)], "k long")
    assert B.join_optional(d, None, ["k"], {"x": "double"}).collect()[0].x is None
    assert B.read_if_there(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    e = spark.createDataFrame([(1, "MEDITATION", 0.0, 50.0)], "session_id long, phase string, start_s double, stop_s double")
    got = {r.segment: (r.start_s, r.stop_s) for r in B.session_segments(e, "session_id", seconds=20.0).collect()}
    assert got == {"OVERALL": (0, 50), "MEDITATION": (0, 50), "MEDITATION_WIN01": (0, 20), "MEDITATION_WIN02": (20, 40), "MEDITATION_WIN03": (40, 50)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "embeddings", "part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name]).df()
    fix = lambda v: None if pd.isna(v) else (round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    table = lambda rows: sorted(repr([fix(v) for v in r]) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a, b = (table(x[names].astype(object).to_numpy()) for x in (got.select(*names).toPandas(), want))
    if a != b:  # a mean on the edge between two roundings may fall to either side
        number = lambda x: isinstance(x, float)
        order = lambda rows: sorted((literal_eval(r) for r in rows), key=lambda r: ([repr(x) for x in r if not number(x) or x == int(x)], [x for x in r if number(x)]))
        assert len(a) == len(b)
        for x, y in zip(order(a), order(b), strict=True):
            assert all(v == pytest.approx(w, rel=1e-9, abs=1.1e-5) if number(v) and number(w) else v == w for v, w in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("wavelet", ["db4", "coif4", "bior4.4"])
def test_wavelet_round_trip(spark, wavelet):
    x = np.random.default_rng(3).normal(size=301).cumsum()
    c = V.decompose(series(spark, x), ["signal"], wavelet=wavelet, level=4, periodic=True)
    depth = {"db4": 4, "coif4": 3, "bior4.4": 4}[wavelet]
    got = {(r.band): r["count"] for r in c.groupBy("band").count().collect()}
    assert got == {0: -(-301 // 2**depth), **{l: -(-301 // 2**l) for l in range(1, depth + 1)}}
    back = V.reconstruct(c, ["signal"], wavelet=wavelet, level=4).orderBy("sample_idx").toPandas()
    assert list(back.sample_idx) == list(range(301)) and np.allclose(back.value, x, atol=1e-7)


def plain_levels(x, wavelet, level, periodic):
    """All levels by loops over places and taps: details by level, then the approximation under 0."""
    low, high, _, _ = V.filters(wavelet)
    taps, out, a = len(low), {}, list(x)
    for l in range(1, level + 1):
        m = len(a)
        if periodic:
            wide, size, shift = a + a[-1:] * (m % 2), -(-m // 2), taps // 2
            at = lambda p: wide[p % len(wide)]  # noqa: B023, E731
        else:
            wide, size, shift = a + a[::-1], (m + taps - 1) // 2, 1
            at = lambda p: wide[p % len(wide)]  # noqa: B023, E731
        out[l] = [sum(high[j] * at(2 * k + shift - j) for j in range(taps)) for k in range(size)]
        a = [sum(low[j] * at(2 * k + shift - j) for j in range(taps)) for k in range(size)]
    return {**out, 0: a}


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize(("wavelet", "level"), [("db4", 4), ("coif4", 2), ("bior4.4", 3)])
@pytest.mark.parametrize("block", [8, 64, None])
def test_wavelet_blocks(spark, wavelet, level, periodic, block):
    """Blocks far smaller than their halos, or that end with a rest, give what plain loops over the whole series give."""
    x = np.random.default_rng(5).normal(size=203).cumsum()
    d = V.decompose(series(spark, x), ["signal"], wavelet=wavelet, level=level, periodic=periodic, block=block)
    got, want = d.toPandas().sort_values("k"), plain_levels(x, wavelet, level, periodic)
    assert len(got) == sum(map(len, want.values()))
    for band, c in want.items():
        assert np.allclose(got[got.band == band].value, c, rtol=1e-9, atol=1e-9), band
    if periodic:
        back = V.reconstruct(d, ["signal"], wavelet=wavelet, level=level, block=block).orderBy("sample_idx").toPandas()
        assert list(back.sample_idx) == list(range(203)) and np.allclose(back.value, x, atol=1e-7)
        part = V.reconstruct(d.filter("band = 2"), ["signal"], wavelet=wavelet, level=level, block=block).toPandas()
        whole = V.reconstruct(d.filter("band = 2"), ["signal"], wavelet=wavelet, level=level).toPandas()
        assert np.allclose(part.sort_values("sample_idx").value, whole.sort_values("sample_idx").value, atol=1e-9)


def test_wavelet_levels_share_one_shuffle(spark):
    d = V.decompose(series(spark, np.arange(500.0)), ["signal"], wavelet="db4", level=5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # the lengths, their join with the samples, the blocks


def test_wavelet_symmetric_edges(spark):
    x = np.random.default_rng(4).normal(size=37)
    low, high, _, _ = V.filters("db4")
    wide = np.concatenate([x[6::-1], x, x[:-8:-1]])
    c = V.decompose(series(spark, x), ["signal"], wavelet="db4", level=1).toPandas()
    for band, h in ((0, low), (1, high)):
        want = [sum(h[j] * wide[7 + 2 * k + 1 - j] for j in range(8)) for k in range(22)]
        assert np.allclose(c[c.band == band].sort_values("k").value, want)


def test_wavelet_clean_edges(spark):
    short = V.wavelet_clean(series(spark, [1, 2, None]), ["session_id", "signal"], fs=4.0, wavelet="bior4.4", level=3).orderBy("sample_idx").toPandas()
    assert list(short.artifact) == [0, 0, 0] and list(short.cleaned[:2]) == [1, 2] and np.isnan(short.cleaned[2])
    assert V.wavelet_clean(series(spark, [1]).limit(0), ["session_id", "signal"], fs=4.0, wavelet="bior4.4", level=3).count() == 0
    x = np.sin(np.arange(400) / 5) + np.where(np.arange(400) == 200, 50.0, 0.0)
    d = V.wavelet_clean(series(spark, x), ["session_id", "signal"], fs=100.0, wavelet="bior4.4", level=3, block_seconds=1.0).orderBy("sample_idx").toPandas()
    assert abs(d.cleaned[200]) < 0.6 * x[200] and np.allclose(d.cleaned + d.artifact, x)


def differing(spark, folder, name: str, keys: list[str], **tables: str) -> list[tuple]:
    """Rows by which a query and its SQL differ, beyond 1e-6, over tables made by DuckDB from those of SF."""
    import duckdb

    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql.format(f"'{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    order = lambda d: d.sort_values(keys).reset_index(drop=True)
    got, want = order(registry.QUERIES[name](spark, str(folder)).toPandas()), order(con.execute(registry.ORACLES[name]).df())
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    near = lambda a, b: a == b or (pd.isna(a) and pd.isna(b)) or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6)
    rows = [d[list(want.columns)].astype(object).to_numpy().tolist() for d in (got, want)]
    return [(a, b) for a, b in zip(*rows, strict=True) if not all(map(near, a, b))] if len(got) == len(want) else [(len(got), len(want))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_series_of_too_few_vectors_equal_sql(spark, tmp_path):
    """The last series short of two vectors, one within a series gone, one null, one twice, one of nulls for the most part."""
    some = "SELECT vec_id, CASE vec_id WHEN 6 THEN NULL WHEN 11 THEN list_transform(embedding, lambda x, i: CASE WHEN i < 3 THEN x END) ELSE embedding END AS embedding FROM {0} WHERE vec_id < 18 AND vec_id <> 1 UNION ALL SELECT vec_id, embedding FROM {0} WHERE vec_id = 13"
    assert differing(spark, tmp_path, "dwt_series_features", ["vec_id", "sub"], embeddings=some) == []


def test_wavelet_of_given_length(spark):
    """Blocks far smaller than their halos: the same values as of a series whose missing places are 0, and no row where nothing reaches."""
    x = np.zeros(256)
    x[100:140] = np.random.default_rng(6).normal(size=40)
    d = series(spark, x).filter("sample_idx >= 100 AND sample_idx < 140")
    want = V.decompose(series(spark, x), ["signal"], wavelet="db4", level=4).toPandas().set_index(["band", "k"]).value
    for block in (16, None):
        got = V.decompose(d, ["signal"], wavelet="db4", level=4, length=256, block=block).toPandas().set_index(["band", "k"]).value
        assert got.index.is_unique and np.allclose(got, want[got.index]) and np.allclose(want.drop(got.index), 0)
        assert set(got.index[got.index.get_level_values(0) == 1]) == {(1, k) for k in range(256) if 2 * k + 1 >= 100 and 2 * k - 6 < 140}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 7, 5000])
def test_describe_is_exact_without_all_values_in_one_buffer(spark, n):
    rng = np.random.default_rng(n)
    x = pd.DataFrame({"wide": rng.normal(size=n) ** 3, "few": rng.integers(0, 4, n).astype(float), "one": np.full(n, 2.5), "none": np.full(n, np.nan), "holes": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "ends": np.where(rng.random(n) < 0.4, -np.inf, np.inf)})
    d = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()], ", ".join(f"{c} double" for c in x)).repartition(5)
    got = {r.metric: r for r in B.describe(d, list(x)).collect()}
    assert set(got) == (set(x) if n else set())
    for c in got:
        v = x[c].dropna().to_numpy()
        assert got[c]["count"] == len(v) and (got[c].min, got[c].max) == ((v.min(), v.max()) if len(v) else (None, None))
        for q in (25, 50, 75):
            low, high = (np.quantile(v, q / 100, method=m) for m in ("lower", "higher")) if len(v) else (None, None)
            want = low if low == high or low == -np.inf < high else low + (high - low) * ((len(v) - 1) * q / 100 % 1)
            between = low is not None and low == -np.inf < high  # no number lies between these
            assert np.isnan(got[c][f"q{q}"]) if between else got[c][f"q{q}"] == want or np.isclose(got[c][f"q{q}"], want, rtol=1e-12), (c, q)
        if c in ("wide", "holes") and len(v) > 1:
            assert np.isclose(got[c]["mean"], v.mean()) and np.isclose(got[c]["std"], v.std(ddof=1))
    assert "percentile(" not in B.describe(d, list(x))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_channels_with_missing_values_equal_sql(spark, tmp_path):
    """Channels null, empty, of zeros, short, with nulls, and of nulls only; an epoch of three."""
    some = "SELECT vec_id, CASE vec_id WHEN 1 THEN NULL WHEN 4 THEN [] WHEN 9 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN 14 THEN embedding[:40] WHEN 19 THEN embedding[:5] WHEN 20 THEN list_transform(embedding, lambda x, i: CASE WHEN i % 7 > 1 THEN x END) WHEN 21 THEN list_transform(embedding, lambda x, i: CASE WHEN i % 5 > 1 THEN x END) WHEN 25 THEN list_transform(embedding, lambda x: NULL::FLOAT) ELSE embedding END AS embedding FROM {0} WHERE vec_id < 31"
    assert differing(spark, tmp_path, "faster_props", ["epoch", "channel"], embeddings=some) == []
