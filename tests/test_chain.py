"""The optical chain, segment measures, sources and the cleaning chain: step by step, closed forms, round trips, SQL twins."""

from __future__ import annotations

import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from neurolith.__main__ import main
from neurolith.operators import chain as A
from neurolith.operators import cleaning as C
from neurolith.operators import features as X
from neurolith.operators import haemodynamics as H
from neurolith.operators import kernels as K
from neurolith.operators import personal as P
from neurolith.operators import vitals as L
from neurolith.plans import registry
from neurolith.sources import recordings as R

registry.load()
SF = "/root/testdata/sf0.001"


def optical(spark, n=900, sessions=(1, 2)):
    rng = np.random.default_rng(3)
    t = np.arange(n) / 10
    out = []
    for s in sessions:
        a = 1000 + 5 * np.sin(2 * np.pi * 0.05 * t + s) + rng.normal(0, 0.5, n) + 0.01 * t
        b = 800 + 4 * np.cos(2 * np.pi * 0.04 * t) + rng.normal(0, 0.5, n)
        a[n // 2 :] += 40
        out.append(pd.DataFrame({"session_id": s, "sample_idx": np.arange(n), "i740": a, "i850": b}))
    d = pd.concat(out)
    return d, spark.createDataFrame(d)


def mixed(x, y):
    (a, b), (c, d) = X.EXTINCTION
    x, y = x / (X.DISTANCE_CM * X.path_factor(740.0)), y / (X.DISTANCE_CM * X.path_factor(850.0))
    both = np.linalg.solve(np.array([[a, b], [c, d]]), np.vstack([x, y])) * 1000
    return both[0], both[1]


def test_optical_chain_step_by_step(spark):
    """Against the order of the definition: concentrations first, then their filters, then a line through all pairs."""
    rows, df = optical(spark, 240, (1,))
    got = H.preprocess(df, ["session_id"], fs=10.0).orderBy("sample_idx").toPandas()
    od = [-np.log10(rows[c] / rows[c].mean()).to_numpy() for c in ("i740", "i850")]
    for name, x in zip(("hbo", "hbr"), mixed(*[K.biweight_derivative(x, 10.0) for x in od]), strict=True):
        x = K.one_sided(x, 10.0, 0.2, "low")
        i = np.arange(len(x))
        slopes = [(x[k] - x[j]) / (k - j) for j in range(len(x)) for k in range(j + 1, len(x))]
        slope = np.median(slopes)
        want = x - slope * i - (np.median(x) - slope * np.median(i))
        assert np.allclose(got[name], want, atol=1e-9)
    assert np.allclose(got.hbt, got.hbo + got.hbr, atol=1e-12) and got.weight_a.isna().sum() == 1


def test_optical_chain_options(spark):
    rows, df = optical(spark)
    m = {r.session_id: r for r in H.motion_fractions(H.preprocess(df, ["session_id"], fs=10.0), ["session_id"]).collect()}
    assert m[1].motion_fraction_1 > 0 and m[1].n_samples == 900
    c = df.selectExpr("session_id", "sample_idx", "CASE WHEN sample_idx % 50 <> 7 THEN i740 END AS hbo", "i850 AS hbr")
    got = H.preprocess(c, ["session_id"], fs=10.0, stage="concentration", repair=False, lowpass=None, detrend="rolling", window_seconds=9.0).filter("session_id = 1").orderBy("sample_idx").toPandas()
    x = rows[rows.session_id == 1].i740.to_numpy().copy()
    x[7::50] = np.nan
    x[7::50] = np.nanmedian(x)
    want = [x[i] - np.median(x[max(0, i - 45) : i + 46]) for i in range(len(x))]  # the ends hold 46 of 91 at least
    assert np.allclose(got.hbo, want, atol=1e-9) and (got.weight_a.dropna() == 1).all()
    with pytest.raises(ValueError):
        H.preprocess(df, ["session_id"], fs=10.0, stage="x")


def test_missing_intensity_stays_missing(spark):
    d = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, None, 2.0)], "session_id long, sample_idx long, i740 double, i850 double")
    assert [r.od740 for r in H.densities(d, ["session_id"]).orderBy("sample_idx").collect()] == [0.0, None]


def test_rates_of_segments(spark):
    t = np.arange(3000) / 50
    beats = spark.createDataFrame(pd.DataFrame({"session_id": "a", "sample_idx": np.arange(3000), "value": np.sin(2 * np.pi * 1.2 * t)}))
    ev = spark.createDataFrame([("a", "REST_BEFORE", 0.0, 20.0), ("a", "MEDITATION", 20.0, 60.0)], "session_id string, phase string, start_s double, stop_s double")
    w = L.segment_hrv(beats, L.window_segments(ev, "session_id", 10.0), "session_id", fs=50.0)
    points = L.window_series(w, "session_id", {"hr_bpm": "hr"}).orderBy("t").collect()
    assert [p.t for p in points] == [5.0, 15.0, 25.0, 35.0, 45.0, 55.0] and all(abs(p.hr - 72) < 1.5 for p in points)
    empty = spark.createDataFrame([("a", "none", 90.0, 95.0)], "session_id string, segment string, start_s double, stop_s double")
    assert L.segment_hrv(beats, empty, "session_id", fs=50.0).first().quality_flag == "NO_VALID_IBI"
    breaths = beats.withColumn("value", (beats.sample_idx / 50 * 0.25 * 2 * np.pi)).selectExpr("session_id", "sample_idx", "sin(value) AS value")
    r = L.segment_breathing(breaths, ev.selectExpr("session_id", "'all' AS segment", "0D AS start_s", "60D AS stop_s").limit(1), "session_id", fs=50.0).first()
    assert abs(r.resp_rate - 15) < 0.5 and r.quality_flag == "OK"


def test_optical_files(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    put("a", "fnirs_raw.csv", "fnirs_2_raw,time_seconds,fnirs_1_raw\r\n5,0.0,1\r\n6,0.1,x\r\n")
    put("a", "fnirs_hbo_hbr.csv", "time_seconds,HbO_uM,HbR_uM\n0,1,2\n")
    put("b", "fnirs_raw.csv", "time_seconds,fnirs_1_raw\n0,1\n")
    put("b", "fnirs_hbo_hbr.csv", "time_seconds,HbR_uM,HbO_uM\n0,2,1\n")
    put("c", "fnirs_raw.csv", "time_seconds,fnirs_1_raw,fnirs_2_raw\n")
    raw, conc, sessions = R.read_optical_sessions(spark, str(tmp_path))
    assert [(r.sample_idx, r.time_seconds, r.i740, r.i850) for r in raw.orderBy("sample_idx").collect()] == [(0, 0.0, 1.0, 5.0), (1, 0.1, None, 6.0)]
    assert [(r.folder[-1], r.hbo, r.hbr) for r in conc.collect()] == [("b", 1.0, 2.0)]
    assert {r.folder[-1]: (r.input_signal_stage, r.input_qc_flags) for r in sessions.collect()} == {"a": ("raw_intensity", ""), "b": ("concentration_fallback", "INVALID_COLUMNS"), "c": (None, "EMPTY_FILE;MISSING_FILE")}


def test_names_matrices_and_durations(spark, tmp_path):
    names = spark.createDataFrame([("/x/P_A1_day3_0af.fif",), ("/x/other.fif",)], "path string")
    assert [tuple(r) for r in names.select(*[c.alias(k) for k, c in R.file_identity(names.path).items()]).collect()] == [("P_A1", 3, "0af"), (None, None, None)]
    x = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.arange(3.0))
    m = R.read_matrices(spark, str(tmp_path), 10.0).toPandas()
    a = m[m.error.isna()]
    assert sorted(a.signal.unique()) == ["E1", "E2"] and np.allclose(a[a.signal == "E2"].sort_values("sample_idx").value, x[:, 1])
    assert m.error.notna().sum() == 1
    (tmp_path / "a.edf").write_bytes(R.encode_edf({"s": np.arange(30.0)}, 10))
    assert R.edf_durations(spark, str(tmp_path)).first().seconds == 3.0


def test_blocks_and_optical_table(spark):
    rows = spark.createDataFrame([("a", i, i // 244, float(i // 244), float(i), float(-i)) for i in range(244 * 3 + 10)], "file string, row_idx long, packet_id long, timestamp double, fnirs_1 double, fnirs_2 double")
    b = R.block_rows(rows, ["file"], 1, 2)
    assert b.agg({"row_idx": "min"}).first()[0] == 0 and b.count() == 488
    t = R.optical_table(b, ["file"]).orderBy("sample_index").collect()
    assert len(t) == 200 and (t[100].packet_timestamp, t[100].fnirs_1_raw, t[100].time_seconds) == (2.0, 488.0, 1.0)


def eeg(spark, n=1000):
    rng = np.random.default_rng(5)
    t = np.arange(n) / 50
    out = []
    for s in ("a", "b"):
        shared = rng.normal(0, 5, n)
        for c, gain in (("X1", 1.0), ("X2", 0.8), ("X3", 1.2)):
            x = gain * (10 * np.sin(2 * np.pi * 6 * t) + shared) + 20 * np.sin(2 * np.pi * 20 * t) + rng.normal(0, 1, n)
            out.append(pd.DataFrame({"session_id": s, "signal": c, "sample_idx": np.arange(n), "value": x}))
        out.append(pd.DataFrame({"session_id": s, "signal": "flat", "sample_idx": np.arange(n), "value": 3.0}))
    out.append(pd.DataFrame({"session_id": "gone", "signal": "X1", "sample_idx": np.arange(n), "value": [None] * n}))
    return spark.createDataFrame(pd.concat(out).astype({"value": float})).selectExpr("session_id", "signal", "sample_idx", "nanvl(value, CAST(NULL AS DOUBLE)) AS value")


def test_cleaning_chain(spark, tmp_path):
    o = A.Settings(fs=50.0, line_frequency=20.0, line_window=2.0, lowpass=22.0, epoch=2.0, wavelet_block=None, reference=None)
    t = A.run(eeg(spark), o, folder=str(tmp_path))
    assert [(r.session_id, r.error_type, r.message) for r in t["errors"].collect()] == [("gone", "LoadFail", "no finite sample")]
    assert {(r.session_id, r.signal): r.bad for r in t["channels"].collect()} == {(s, c): c == "flat" for s in "ab" for c in ("X1", "X2", "X3", "flat")}
    d = t["cleaned"].filter("session_id = 'a' AND signal = 'X1'").orderBy("sample_idx").toPandas().value.to_numpy()
    power = np.abs(np.fft.rfft(d)) ** 2
    assert len(d) == 1000 and power[400] < 0.05 * power[120]  # 20 Hz is gone, 6 Hz is there
    q = {r.session_id: r for r in t["quality"].collect()}
    assert (q["a"].n_channels, q["a"].n_good, q["a"].n_epochs) == (4, 3, 10) and q["gone"].n_epochs == 0
    assert t["epochs"].count() == 2 * 3 * 10


def test_evoked_chain(spark, tmp_path):
    events = spark.createDataFrame([("a", 200, "x"), ("a", 990, "y")], "session_id string, onset long, tag string")
    o = A.Settings.of({"fs": 50.0, "evoked": True, "threshold": "soft", "lowpass": 22.0, "line_frequency": None, "wavelet": False, "reference": None, "include": ["X1", "X2", "X3"], "repair_cutoff": 2.0})
    t = A.run(eeg(spark), o, events, folder=str(tmp_path))
    assert sorted((r.session_id, r.error_type) for r in t["errors"].collect()) == [("b", "NoTags"), ("gone", "LoadFail")]
    e = t["epochs"].collect()
    assert [(r.session_id, r.epoch, r.tag, len(r.a)) for r in e] == [("a", 200, "x", 51)] * 3 and all(abs(np.mean(r.a[:10])) < 1e-9 for r in e)
    with pytest.raises(A.SettingsError):
        A.run(eeg(spark), o)


def test_settings():
    assert A.Settings.from_json(A.EVOKED.to_json()) == A.EVOKED
    for wrong in ({"threshold": "x"}, {"highpass": 50.0}, {"nothing": 1}):
        with pytest.raises(A.SettingsError):
            A.Settings.of(wrong)


def test_command_line(spark, tmp_path, capsys):
    assert main(["settings", "--evoked"]) == 0 and A.Settings.from_json(capsys.readouterr().out) == A.EVOKED
    eeg(spark, 400).filter("session_id = 'gone'").write.parquet(str(tmp_path / "s"))
    assert main(["clean", str(tmp_path / "s"), str(tmp_path / "out")]) == 1
    assert spark.read.parquet(str(tmp_path / "out" / "errors")).count() == 1


def test_an_error_inside_a_step_ends_one_recording_only(spark, tmp_path):
    o = A.Settings(fs=50.0, line_frequency=20.0, line_window=2.0, lowpass=22.0, epoch=2.0, wavelet=False, reference="subset", reference_channels=("X1",), rejection_channels=("X2",), most_line_z=None)
    d = eeg(spark)
    huge = d.filter("session_id = 'a'").selectExpr("'huge' AS session_id", "signal", "sample_idx", "CASE WHEN signal = 'X2' AND sample_idx > 100 THEN 1e308 * (1 - 2 * (sample_idx % 2)) ELSE value END AS value")
    odd = d.filter("session_id = 'b'").selectExpr("'odd' AS session_id", "signal", "sample_idx", "value * 1000 AS value")

    def picky(x):
        if np.abs(x).max() > 1000:
            raise ValueError("too large")
        return x

    t = A.run(d.unionByName(huge).unionByName(odd), o, folder=str(tmp_path / "x"), own={"picky": picky})
    alone = A.run(d, o, folder=str(tmp_path / "y"), own={"picky": picky})
    errors = {r.session_id: (r.step, r.error_type, r.message) for r in t["errors"].collect()}
    assert set(errors) == {"gone", "huge", "odd"}
    assert errors["gone"][:2] == ("load", "LoadFail") and errors["huge"][:2] == ("line", "StepFailed") and errors["odd"] == ("picky", "StepFailed", "X1: ValueError: too large")
    for name in ("cleaned", "channels", "epochs", "steps"):
        rows = lambda x: sorted(map(str, x[name].filter("session_id <> 'odd'").collect()))  # noqa: E731, B023
        assert rows(t) == rows(alone) and rows(t)
        assert name == "channels" or not t[name].filter("session_id = 'odd'").count()  # found before the step
    assert t["cleaned"].filter("signal = 'X1'").selectExpr("max(abs(value))").first()[0] == 0  # the reference
    s = t["steps"].filter("session_id = 'a'").first()
    assert s.lineNoise_coherence_20Hz < 0.2 and 0 < s.lineNoise_percent_variance_retained < 90 and s.lineNoise_cross_correlation < 0.95
    record = json.loads(spark.read.text(str(tmp_path / "x" / "record"), wholetext=True).first()[0])
    assert record["rows"]["cleaned"] == t["cleaned"].count() and record["rows"]["errors"] == 3 and A.Settings.of(record["settings"]) == o


def test_chain_of_the_other_methods(spark, tmp_path):
    o = A.Settings(fs=50.0, resample_to=40, line_frequency=16.0, line_method="tapers", line_window=4.0, filter_method="fir", highpass=2.0, lowpass=18.0, heart_beats=True, heart_epoch=6.0, wavelet_overlap=0.5, wavelet_block=2.0, pulled_channel="X3", components=True, most_slope=1e9)
    t = A.run(eeg(spark), o, folder=str(tmp_path))
    assert t["cleaned"].groupBy("session_id", "signal").count().filter("count = 800").count() == 2 * 3
    assert {r.session_id for r in t["errors"].collect()} == {"gone"}
    assert {(r.session_id, r.signal): r.bad for r in t["channels"].collect()} == {(s, c): c == "flat" for s in "ab" for c in ("X1", "X2", "flat")}
    assert {r.pct_rejected for r in t["steps"].collect()} == {0.0}
    assert set(t["steps"].columns) > {"alpha_power_before", "alpha_power_after", "alpha_power_retained_pct", "n_components", "wavelet_percent_variance_retained", "lineNoise_coherence_16Hz", "wavelet_rmse"}
    notch = A.run(eeg(spark), A.Settings(fs=50.0, line_frequency=20.0, line_method="notch", lowpass=22.0, wavelet=False), folder=str(tmp_path / "n"))
    d = notch["cleaned"].filter("session_id = 'a' AND signal = 'X1'").orderBy("sample_idx").toPandas().value.to_numpy()
    power = np.abs(np.fft.rfft(d)) ** 2
    assert len(d) == 1000 and power[400] < 0.05 * power[120]


def test_every_component_rejected_is_an_error(spark, tmp_path):
    o = A.Settings(fs=100.0, line_frequency=None, lowpass=45.0, wavelet=False, components=True, most_slope=-1e9, include=("X1", "X2"))
    t = A.run(eeg(spark), o, folder=str(tmp_path))
    assert {(r.session_id, r.error_type, r.step) for r in t["errors"].collect()} == {("gone", "LoadFail", "load"), ("a", "AllComponentsRejected", "component_choice"), ("b", "AllComponentsRejected", "component_choice")}
    assert t["cleaned"].count() == 0 and t["quality"].count() == 3


def test_band_power_before_and_after(spark):
    t = np.arange(3000) / 100
    x = {c: g * np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 20 * t) for c, g in (("X", 1.0), ("Y", 2.0))}
    rows = pd.concat([pd.DataFrame({"session_id": "a", "signal": c, "sample_idx": np.arange(3000), "pre": v, "post": v - 0.5 * np.sin(2 * np.pi * 20 * t)}) for c, v in x.items()])
    r = P.band_power_retained(spark.createDataFrame(rows), "session_id", "signal", fs=100.0).first()
    assert abs(r.alpha_power_before - (0.5 + 2) / 2) < 0.01 and abs(r.alpha_power_retained_pct - 100) < 1e-6 and abs(r.beta_power_retained_pct - 25) < 0.01


def test_rounds_of_line_removal_come_to_the_joint_fit(spark):
    n, rng = 300, np.random.default_rng(3)
    x, i = rng.normal(size=n), np.arange(n)
    a = np.column_stack([f(2 * np.pi * q / 100.0 * i) for q in (10.0, 10.4) for f in (np.cos, np.sin)])
    want = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
    d = spark.createDataFrame(pd.DataFrame({"session_id": "a", "signal": "X", "sample_idx": i, "value": x}))
    error = [np.abs(C.remove_line(d, ["session_id", "signal"], fs=100.0, freqs=[10.0, 10.4], seconds=3.0, rounds=k).orderBy("sample_idx").toPandas().cleaned - want).max() for k in (1, 6)]
    assert error[1] < 0.1 * error[0]
