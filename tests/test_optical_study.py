"""The optical study from a folder to its tables, and its operators against plain numpy."""

import json

import numpy as np
import pytest

from neurolith.__main__ import main
from neurolith.operators import kernels as K
from neurolith.operators import optical_study as O
from neurolith.operators import spectra as P
from neurolith.operators import study as T


def write(folder, name, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *[",".join(str(v) for v in r) for r in rows]]) + "\n")


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """Four sessions at 10 Hz: intensities with events, concentrations with events that don't fit, with none, and an empty file."""
    root = tmp_path_factory.mktemp("study")
    at = lambda p, d, s: root / "in" / f"participant={p}" / f"study_day={d}" / f"session_id={s}"
    t, rng = np.arange(1200) / 10, np.random.default_rng(1)
    write(at("A", 1, "raw"), "fnirs_raw.csv", "time_seconds,fnirs_1_raw,fnirs_2_raw", zip(t, 1000 + 5 * np.sin(t) + rng.normal(size=1200), 900 + 4 * np.cos(t) + rng.normal(size=1200), strict=True))
    events = "latency,duration_samples,description"
    write(at("A", 1, "raw"), "event_labels_block.csv", events, [(0, 244 * 40, "REST_BEFORE"), (244 * 40, 244 * 40, "MEDITATION"), (244 * 80, 244 * 40, "REST_AFTER")])
    write(at("A", 2, "odd"), "fnirs_hbo_hbr.csv", "time_seconds,HbO_uM,HbR_uM", zip(t, np.sin(t / 9), np.cos(t / 9), strict=True))
    write(at("A", 2, "odd"), "event_labels_block.csv", events, [(0, 244 * 5, "REST_BEFORE"), (244 * 5, 244 * 300, "MEDITATION"), (244 * 4, 244 * 2, "MEDITATION")])
    write(at("B", 1, "none"), "fnirs_hbo_hbr.csv", "time_seconds,HbO_uM,HbR_uM", zip(t, np.sin(t / 9), np.cos(t / 9), strict=True))
    write(at("B", 2, "empty"), "fnirs_raw.csv", "time_seconds,fnirs_1_raw,fnirs_2_raw", [])
    return O.run_study(spark, str(root / "in"), str(root / "out"), O.Settings(fs=10.0, window=30.0, step=10.0, bins=100, least_third=20.0)), root


def test_log_has_every_session(study):
    log = {r.session_id: r for r in study[0]["run_log"].collect()}
    assert {k: (r.participant_key, r.study_day, r.status) for k, r in log.items()} == {"raw": ("A", 1, "OK"), "odd": ("A", 2, "OK"), "none": ("B", 1, "OK"), "empty": ("B", 2, "NO_INPUT_DATA")}
    assert log["raw"].length_unchanged and log["raw"].n_samples_after == 1200 and log["empty"].n_samples_after is None
    assert log["raw"].input_signal_stage == "raw_intensity" and log["odd"].input_signal_stage == "concentration_fallback"
    flags = {k: set(r.session_qc_flags.split(";")) for k, r in log.items()}
    assert {"INVALID_BASELINE", "MISSING_BASELINE", "EVENT_CLIPPED", "MISSING_PHASE", "PHASE_OVERLAP"} <= flags["odd"]
    assert {"MISSING_PHASE", "MISSING_BASELINE"} <= flags["none"] and "EMPTY_FILE" in flags["empty"] and not flags["raw"] & {"MISSING_PHASE", "MISSING_BASELINE"}


def test_phases_and_changes(study):
    tables, _ = study
    rows = tables["phase_by_phase"].toPandas()
    assert set(rows[rows.session_id == "raw"].phase) == {"REST_BEFORE", "MEDITATION", "REST_AFTER", "MEDITATION_EARLY", "MEDITATION_MIDDLE", "MEDITATION_LATE"}
    assert set(rows[rows.session_id == "none"].phase) == {"OVERALL"} and set(rows[rows.session_id == "odd"].phase) >= {"MEDITATION", "MEDITATION#2"}
    assert not rows[rows.session_id == "none"].qc_pass.any() and not rows.duplicated(["session_id", "phase", "variant", "signal"]).any()
    x = tables["processed"].filter("folder LIKE '%session_id=raw'").orderBy("sample_idx").toPandas()
    r = rows[(rows.session_id == "raw") & (rows.variant == "stable_phase") & (rows.signal == "hbo")].set_index("phase")
    assert (r.loc["MEDITATION"].start_idx, r.loc["MEDITATION"].stop_idx) == (550, 800) and r.loc["MEDITATION_EARLY"].start_idx == 550
    assert r.loc["MEDITATION"]["median"] == pytest.approx(x.hbo[550:800].median())
    assert r.loc["MEDITATION"].median_delta == pytest.approx(x.hbo[550:800].median() - x.hbo[100:400].median())
    c = tables["session_changes"].filter("session_id = 'raw' AND variant = 'full_phase' AND signal = 'hbr' AND metric = 'mean' AND phase_from = 'REST_BEFORE' AND phase_to = 'REST_AFTER'").first()
    assert c.change == pytest.approx(x.hbr[800:].mean() - x.hbr[:400].mean())
    wide = tables["wide_by_session"].filter("session_id = 'raw'").first()
    assert wide["MEDITATION__stable_phase__hbo__median"] == pytest.approx(x.hbo[550:800].median()) and tables["wide_by_session"].count() == 3


def test_summary_hashes_and_record(study):
    import hashlib

    tables, root = study
    counts = {r.qc_flag: r.n_rows for r in tables["qc_summary"].collect()}
    rows = tables["phase_by_phase"].toPandas()
    want = [f for a, b in zip(rows.qc_flags, rows.session_qc_flags, strict=True) for f in {*a.split(";"), *b.split(";")} if f]
    assert counts == {f: want.count(f) for f in set(want)}
    for r in tables["input_hashes"].collect():
        assert hashlib.sha256(open(r.file.replace("file:", ""), "rb").read()).hexdigest() == r.sha256
    record = json.loads(tables["record"].first().record)
    assert record["settings"]["fs"] == 10.0 and record["n_sessions"] == 4 and record["n_phase_rows"] == len(rows) and record["spark"]


def test_study_without_events(spark, tmp_path):
    write(tmp_path / "in" / "x", "fnirs_hbo_hbr.csv", "time_seconds,HbO_uM,HbR_uM", [(i / 10, i % 7, -(i % 5)) for i in range(300)])
    t = O.run_study(spark, str(tmp_path / "in"), str(tmp_path / "out"), O.Settings(fs=10.0, window=10.0, step=5.0, bins=50))
    assert {r.phase for r in t["phase_by_phase"].collect()} == {"OVERALL"} and t["event_alignment"].count() == 0


def test_study_by_command(spark, tmp_path):
    write(tmp_path / "in" / "x", "fnirs_hbo_hbr.csv", "time_seconds,HbO_uM,HbR_uM", [])
    (tmp_path / "s.json").write_text('{"fs": 10.0, "low_band": [0.05, 0.1]}')
    assert main(["study", str(tmp_path / "in"), str(tmp_path / "out"), "--settings", str(tmp_path / "s.json")]) == 1
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out" / "run_log")).collect()] == ["NO_INPUT_DATA"]
    with pytest.raises(ValueError, match="unknown settings"):
        O.Settings.from_json('{"rate": 1}')


def test_cross_features(spark):
    fs, rng = 100.0, np.random.default_rng(4)
    x, y = rng.normal(size=(2, 300))
    y[:150] += x[:150]
    d = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(300)] + [("b", 0, 1.0, 2.0), ("c", 0, 1.0, None)], "id string, sample_idx long, x double, y double")
    got = {r.id: r for r in P.cross_features(d, ["id"], fs=fs, size=100).collect()}
    assert set(got) == {"a", "b"} and got["b"].alpha_asymmetry is None and got["b"].entropy_sum == pytest.approx(0, abs=1e-9)

    def entropy(v):
        p = (np.abs(v) + 1e-8) / (np.abs(v) + 1e-8).sum()
        return -(p * np.log(p)).sum()

    w, f = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(100) / 100), np.arange(51)
    fx, fy = (np.array([np.fft.rfft((z[s : s + 100] - z[s : s + 100].mean()) * w) for s in range(0, 201, 50)]) for z in (x, y))
    scale = np.r_[1, [2] * 49, 1] / (fs * (w * w).sum())
    px, py = ((np.abs(v) ** 2).mean(axis=0) * scale for v in (fx, fy))
    c = (np.conj(fx) * fy).mean(axis=0) * scale
    at = lambda p, lo, hi: p[(f >= lo) & (f <= hi)].sum()
    r = got["a"]
    assert r.entropy_difference == pytest.approx(entropy(x) - entropy(y)) and r.entropy_sum == pytest.approx(entropy(x) + entropy(y))
    assert r.alpha_asymmetry == pytest.approx(np.log(at(py, 8, 12) + 1e-8) - np.log(at(px, 8, 12) + 1e-8))
    assert r.engagement_index == pytest.approx((at(px, 13, 30) + at(py, 13, 30)) / (at(px, 8, 12) + at(py, 8, 12) + at(px, 4, 7) + at(py, 4, 7) + 1e-8))
    assert r.coherence_beta == pytest.approx((np.abs(c) ** 2 / (px * py))[13:31].mean())


def test_reports_of_participants(spark):
    m = spark.createDataFrame([("A", 2, 5, "primary_valid", "INCLUDED", "PASS", "FAIL", "x"), ("A", 1, 9, "primary_valid", "EXCLUDED_L1", "FAIL", None, "y"), ("B", 1, 1, "invalid_attempt", "EXCLUDED_L1", "FAIL", "FAIL", None), (None, 1, 2, "primary_valid", "INCLUDED", "PASS", "PASS", None)],
                              "participant_key string, study_day int, session_id long, session_role string, final_label string, overall_label string, eeg_label string, participant_name string")
    got = {r.participant_key: r for r in T.participant_report(m).collect()}
    assert set(got) == {"A", "B", None} and (got["A"].participant_name, got["A"].eeg_fail_rate_percent, got["A"].group_name) == ("y", 50.0, None)
    assert got["B"].eeg_fail_rate_percent is None and got["A"].ppg_fail_rate_percent is None and got[None].days_included == 1
    q = spark.createDataFrame([("f1", 1.0), ("f2", 2.0), (None, 3.0)], "File string, kept double")
    i = spark.createDataFrame([("f1", "A", 2, "s2"), ("f1", "A", 1, "s1")], "File string, participant_key string, study_day int, session_id string")
    assert sorted(((r.File or "", r.session_id) for r in T.with_identity(q, i).collect())) == [("", None), ("f1", "s1"), ("f2", None)]
    s = spark.createDataFrame([("A", 3, "s1"), ("A", 3, "s2"), ("A", 120, "s9")], "participant_key string, study_day int, session_id string")
    wanted = spark.createDataFrame([("A", 3), ("A", 4), ("A", 120)], "participant_key string, study_day int")
    assert {r.study_day: r.folder for r in T.session_folders(wanted, s, "/d").collect()} == {3: "/d/participant=A/study_day=03/session_id=s2", 4: None, 120: "/d/participant=A/study_day=120/session_id=s9"}


def test_segment_measures(spark):
    fs, rng = 8.0, np.random.default_rng(2)
    x = rng.normal(size=(3, 400)).cumsum(axis=1)
    x[0, 50] = np.nan
    rows = [(1, i, *[None if np.isnan(v) else float(v) for v in x[:, i]]) for i in range(400)]
    session = spark.createDataFrame(rows, "id long, sample_idx long, hbo double, hbr double, hbt double")
    segments = spark.createDataFrame([(1, "long", 20, 400), (1, "part", 100, 200), (1, "tiny", 0, 9), (1, "none", 900, 950)], "id long, segment string, start_idx long, stop_idx long")
    got = {r.segment: r for r in O.segment_measures(session, segments, ["id"], fs=fs, seconds=30.0).collect()}
    assert set(got) == {"long", "part", "tiny"} and got["tiny"].hbo_mean_uM is None and got["tiny"].freq_domain_duration_s == 0 and got["part"].low_freq_power_ratio is None
    y = x[0, 20:400].copy()
    y[np.isnan(y)] = np.nanmedian(y)
    y = K.one_sided(y, fs, 0.2, "low")
    r = got["long"]
    assert r.n_samples == 380 and r.hbo_mean_uM == pytest.approx(y.mean()) and r.hbo_sd_uM == pytest.approx(y.std(ddof=1)) and r.hbo_peak_to_peak_uM == pytest.approx(np.ptp(y))
    assert r.hbo_slope_uM_per_min == pytest.approx(np.polyfit(np.arange(380) / fs / 60, y, 1)[0])
    w, p = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(240) / 240), []
    for s in range(0, 380 - 240 + 1, 120):
        z = y[s : s + 240]
        p.append(np.abs(np.fft.rfft((z - z.mean()) * w)) ** 2)
    p, f = np.mean(p, axis=0) * np.r_[1, [2] * 119, 1], np.arange(121) * fs / 240
    area = lambda lo, hi: np.trapezoid(p[(f >= lo) & (f <= hi)], f[(f >= lo) & (f <= hi)])
    assert r.low_freq_power_ratio == pytest.approx(area(0.02, 0.1) / area(0.02, 0.5))


def test_flag_tiers_of_empty_and_null(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "ROBUST_OUTLIER;ROBUST_OUTLIER"), (4, "FLAT_SIGNAL;MISSING_BASELINE")], "id long, f string")
    got = {r.id: (r.qc_flag_count, r.has_stat_flag, r.has_signal_flag, r.qc_pass) for r in O.flag_tiers(d, "f").collect()}
    assert got == {1: (0, False, False, True), 2: (0, False, False, True), 3: (1, True, False, True), 4: (2, False, True, False)}
