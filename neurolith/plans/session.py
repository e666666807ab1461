"""The whole way from samples and packets to a session's decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import measures as M
from neurolith.operators import session as D
from neurolith.operators import signal as S
from neurolith.plans.fixtures import SQL, samples
from neurolith.plans.quality import LABELS, flagged, packets, rounded
from neurolith.plans.registry import query

KEYS = ["session_id", "signal"]
#: Limits that fire on the given tables.
LIMITS = {
    "missing": 4.0, "clipping": 1.65, "flatline": 0.095, "artifact_severe": 16.0, "artifact_moderate": 9.0, "dynamic_eeg": 1.75, "uncorrelated": 0.0, "low_ratio": 0.8, "valid_ibi_fail": 20.0, "valid_ibi": 40.0, "good_fail": 60.0, "good": 92.0,
    "hr_low": 60.0, "hr_high": 90.0, "cv_fail": 105.0, "cv": 98.0, "coupling_fail": -0.05, "coupling": 0.02, "duration": 420_000.0, "global_fail": 2.8, "global": 0.5, "imbalance": 1.05, "dynamic_ppg_fail": 4.0, "dynamic_ppg": 2.3,
}
MOST_INTERVAL = 2_400_000


def measured(spark, sf):
    """One row per session and signal with the measures that its modality is judged by; values are missing at every 37th event."""
    s = samples(spark, sf).withColumn("raw", F.when(F.col("event_id") % 37 != 0, F.col("value")))
    raw = s.groupBy(*KEYS).agg((100.0 - F.count("raw") * 100.0 / F.count(F.lit(1))).alias("missing_percent"), (F.stddev_pop("raw") / F.abs(F.avg("raw")) * 100).alias("raw_cv_percent"))
    clip = S.clipping_percent(s.withColumn("value", F.round("raw")))
    flat = S.longest_flatline(s.withColumn("value", F.round(F.col("raw") / 50)), 100.0).withColumnRenamed("longest_flatline_seconds", "flatline_seconds")
    w = flagged(spark, sf).groupBy(*KEYS).agg((F.avg(F.col("artifact").cast("double")) * 100).alias("artifact_percent"), (F.avg((F.col("high_fraction") > 0.15).cast("double")) * 100).alias("_high"), S.dynamic_ratio("rms", 0.95, 2.0).alias("dynamic_ratio"))
    at = lambda x: F.max(F.when(F.col("signal") == x, F.col("raw"))).alias(x)
    pairs = s.groupBy("session_id", "sample_idx").agg(*[at(x) for x in ("AF3", "AF4", "fNIRS_1", "fNIRS_2")]).groupBy("session_id").agg(F.corr("AF3", "AF4").alias("_eeg"), F.corr("fNIRS_1", "fNIRS_2").alias("_optical"))
    gap = F.col("sample_idx") - F.lag("sample_idx").over(S.by(*KEYS, order="sample_idx"))
    beats = s.filter((F.col("signal") == "PPG") & (F.col("raw") > 100)).withColumn("_g", gap * 0.4).filter("_g IS NOT NULL")
    fine = F.col("_g").between(0.4, 1.5)
    beats = beats.groupBy(*KEYS).agg((F.avg(fine.cast("double")) * 100).alias("valid_ibi_percent"), F.median(F.when(fine, 60 / F.col("_g"))).alias("median_hr_bpm"))
    d = raw.join(clip, KEYS).join(flat, KEYS).join(w, KEYS, "left").join(beats, KEYS, "left").join(pairs, "session_id")
    kind = F.when(F.col("signal").startswith("AF"), "EEG").when(F.col("signal") == "PPG", "PPG").otherwise("fNIRS")
    only = lambda m, c: F.when(F.col("modality") == m, F.col(c))
    d = d.withColumn("modality", kind).withColumn("amplitude_bad_percent", F.lit(0.1) * only("EEG", "_high")).withColumn("good_percent", 100 - only("PPG", "artifact_percent"))
    return d.withColumn("channel_correlation", only("EEG", "_eeg")).withColumn("low_ratio", F.when(F.col("modality") == "EEG", 0.9)).withColumn("coupling_index", only("fNIRS", "_optical")).drop("_eeg", "_optical", "_high")


MEASURED = LABELS + """,
rw AS (SELECT *, CASE WHEN event_id % 37 <> 0 THEN value END AS raw FROM s),
m1 AS (SELECT session_id, signal, 100.0::DOUBLE - count(raw) * 100.0::DOUBLE / count(*) AS missing_percent, stddev_pop(raw) / abs(avg(raw)) * 100 AS raw_cv_percent, min(round(raw)) AS lo, max(round(raw)) AS hi FROM rw GROUP BY ALL),
m2 AS (SELECT session_id, signal, sum(CASE WHEN round(raw) = lo OR round(raw) = hi THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(raw) AS clipping_percent FROM rw JOIN m1 USING (session_id, signal) GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN abs(round(raw / 50) - lag(round(raw / 50)) OVER (PARTITION BY session_id, signal ORDER BY sample_idx)) <= 0 THEN 1 ELSE 0 END AS same FROM rw),
f2 AS (SELECT *, sum(1 - same) OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS run FROM f1), f3 AS (SELECT session_id, signal, run, sum(same) AS n FROM f2 GROUP BY ALL),
m3 AS (SELECT session_id, signal, CASE WHEN max(n) > 0 THEN (max(n) + 1) / 100.0::DOUBLE ELSE 0.0 END AS flatline_seconds FROM f3 GROUP BY ALL),
m4 AS (SELECT session_id, signal, avg(CASE WHEN artifact THEN 1.0 ELSE 0.0 END) * 100 AS artifact_percent, avg(CASE WHEN high_fraction > 0.15 THEN 1.0 ELSE 0.0 END) * 10 AS high, quantile_cont(rms, 0.95) / greatest(median(rms), 2.0) AS dynamic_ratio FROM fl GROUP BY ALL),
pv AS (SELECT session_id, sample_idx, max(CASE WHEN signal = 'AF3' THEN raw END) AS a, max(CASE WHEN signal = 'AF4' THEN raw END) AS b, max(CASE WHEN signal = 'fNIRS_1' THEN raw END) AS x, max(CASE WHEN signal = 'fNIRS_2' THEN raw END) AS y FROM rw GROUP BY ALL),
m5 AS (SELECT session_id, corr(a, b) AS ce, corr(x, y) AS co FROM pv GROUP BY 1),
bt AS (SELECT session_id, signal, (sample_idx - lag(sample_idx) OVER (PARTITION BY session_id ORDER BY sample_idx)) * 0.4::DOUBLE AS g FROM rw WHERE signal = 'PPG' AND raw > 100),
m6 AS (SELECT session_id, signal, avg(CASE WHEN g BETWEEN 0.4 AND 1.5 THEN 1.0 ELSE 0.0 END) * 100 AS valid_ibi_percent, median(CASE WHEN g BETWEEN 0.4 AND 1.5 THEN 60 / g END) AS median_hr_bpm FROM bt WHERE g IS NOT NULL GROUP BY ALL),
me AS (SELECT session_id, signal, CASE WHEN signal LIKE 'AF%' THEN 'EEG' WHEN signal = 'PPG' THEN 'PPG' ELSE 'fNIRS' END AS modality, missing_percent, raw_cv_percent, clipping_percent, flatline_seconds, artifact_percent, CASE WHEN signal LIKE 'AF%' THEN high END AS amplitude_bad_percent, dynamic_ratio,
  CASE WHEN signal LIKE 'AF%' THEN ce END AS channel_correlation, CASE WHEN signal LIKE 'fN%' THEN co END AS coupling_index, valid_ibi_percent, median_hr_bpm, CASE WHEN signal = 'PPG' THEN 100 - artifact_percent END AS good_percent
  FROM m1 JOIN m2 USING (session_id, signal) JOIN m3 USING (session_id, signal) LEFT JOIN m4 USING (session_id, signal) LEFT JOIN m6 USING (session_id, signal) JOIN m5 USING (session_id)),
ru AS (SELECT *, coalesce(missing_percent > {missing} OR clipping_percent > {clipping} OR flatline_seconds > {flatline}, FALSE) AS st,
  coalesce(artifact_percent > {artifact_severe} OR amplitude_bad_percent > {artifact_severe}, FALSE) AS sv, coalesce(artifact_percent > {artifact_moderate} OR amplitude_bad_percent > {artifact_moderate} OR dynamic_ratio > {dynamic_eeg}, FALSE) AS mo, coalesce(0.9 > {low_ratio} AND channel_correlation < {uncorrelated}, FALSE) AS dm,
  coalesce(valid_ibi_percent < {valid_ibi_fail} OR good_percent < {good_fail} OR dynamic_ratio > {dynamic_ppg_fail}, FALSE) AS np, coalesce(median_hr_bpm < {hr_low} OR median_hr_bpm > {hr_high}, FALSE) AS od, coalesce(valid_ibi_percent < {valid_ibi} OR good_percent < {good} OR dynamic_ratio > {dynamic_ppg}, FALSE) AS wk,
  coalesce(coupling_index < {coupling_fail}, FALSE) AS po, coalesce(coupling_index >= {coupling_fail} AND coupling_index < {coupling}, FALSE) AS ma, coalesce(artifact_percent > {artifact_severe} OR raw_cv_percent > {cv_fail}, FALSE) AS un, coalesce(artifact_percent > {artifact_moderate} OR raw_cv_percent > {cv}, FALSE) AS sh FROM me),
lb AS (SELECT *, CASE modality WHEN 'EEG' THEN st OR sv WHEN 'PPG' THEN st OR np OR od ELSE st OR un OR po END AS bad, CASE modality WHEN 'EEG' THEN mo OR dm WHEN 'PPG' THEN wk ELSE sh OR ma END AS held FROM ru),
sg2 AS (SELECT *, CASE WHEN bad THEN 'FAIL' WHEN held THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS label,
  coalesce(nullif(concat_ws(';', CASE WHEN st THEN 'structural_signal_failure' END, CASE WHEN modality = 'EEG' AND sv THEN 'severe_recurrent_artifact' END, CASE WHEN modality = 'EEG' AND NOT bad AND mo THEN 'moderate_artifact_burden' END, CASE WHEN modality = 'EEG' AND NOT bad AND dm THEN 'low_frequency_dominance_uncorrelated' END,
  CASE WHEN modality = 'PPG' AND np THEN 'poor_pulse_detectability' END, CASE WHEN modality = 'PPG' AND od THEN 'implausible_median_heart_rate' END, CASE WHEN modality = 'PPG' AND NOT bad AND wk THEN 'moderate_ppg_artifact' END,
  CASE WHEN modality = 'fNIRS' AND NOT st AND (un OR po) THEN CASE WHEN po THEN 'poor_scalp_coupling' ELSE 'severe_optical_instability' END END, CASE WHEN modality = 'fNIRS' AND NOT bad AND (sh OR ma) THEN CASE WHEN ma THEN 'marginal_scalp_coupling' ELSE 'moderate_optical_instability' END END), ''),
  CASE modality WHEN 'EEG' THEN 'acceptable_qc_metrics' WHEN 'PPG' THEN 'stable_pulse_waveform' ELSE 'stable_raw_optical_intensity' END) AS reasons FROM lb)"""
for _k, _v in LIMITS.items():
    MEASURED = MEASURED.replace(f"{{{_k}}}", repr(_v))


def decided(spark, sf):
    return D.signal_decisions(measured(spark, sf), F.col("modality"), LIMITS)


@query("qc_signal_decisions", MEASURED + " SELECT session_id, signal, round(missing_percent, 6) AS missing_percent, round(clipping_percent, 6) AS clipping_percent, flatline_seconds, round(artifact_percent, 6) AS artifact_percent, round(dynamic_ratio, 6) AS dynamic_ratio, round(raw_cv_percent, 5) AS raw_cv_percent, label, reasons FROM sg2")
def qc_signal_decisions(spark, sf):
    d = decided(spark, sf).select(*KEYS, "missing_percent", "clipping_percent", "flatline_seconds", "artifact_percent", "dynamic_ratio", "raw_cv_percent", "label", "reasons")
    return rounded(rounded(d, "missing_percent", "clipping_percent", "artifact_percent", "dynamic_ratio"), "raw_cv_percent", places=5)


@query("qc_session_decision", MEASURED + f""",
pk AS (SELECT CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS session_id, CAST(epoch_us(ts) // 1000 AS BIGINT) // 30000 * 30000 AS t FROM events), pg AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS gap FROM pk),
rc AS (SELECT session_id, (max(t) - min(t)) / 1000.0::DOUBLE AS duration, count(*) FILTER (gap > {MOST_INTERVAL}) AS gaps, count(t) - count(DISTINCT t) AS dup FROM pg GROUP BY 1),
rr AS (SELECT session_id, sqrt(avg(value * value) FILTER (signal = 'AF3')) AS a, sqrt(avg(value * value) FILTER (signal = 'AF4')) AS b FROM s GROUP BY 1),
ss AS (SELECT session_id, max(CASE WHEN signal = 'AF3' THEN label END) AS a, max(CASE WHEN signal = 'AF4' THEN label END) AS b, max(CASE WHEN signal = 'PPG' THEN label END) AS p, max(CASE WHEN signal = 'fNIRS_1' THEN label END) AS x, max(CASE WHEN signal = 'fNIRS_2' THEN label END) AS y FROM sg2 GROUP BY 1),
j AS (SELECT rc.*, ss.* EXCLUDE (session_id), coalesce(g.global_artifact_percent, 100.0) AS g, greatest(rr.a, rr.b) / greatest(least(rr.a, rr.b), 1e-12) > {LIMITS['imbalance']} AS uneven FROM rc LEFT JOIN ss USING (session_id) LEFT JOIN gp g USING (session_id) JOIN rr USING (session_id)),
k AS (SELECT session_id, g, uneven, duration < {LIMITS['duration']} AS short, gaps > 0 AS gp, dup > 0 AS dp, CASE WHEN duration < {LIMITS['duration']} THEN 'FAIL' WHEN gaps > 0 OR dup > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS recording_label,
  CASE WHEN a = 'FAIL' OR b = 'FAIL' THEN 'FAIL' WHEN a = 'CONDITIONAL_PASS' OR b = 'CONDITIONAL_PASS' THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS eeg_label, p AS ppg_label, CASE WHEN x = 'FAIL' AND y = 'FAIL' THEN 'FAIL' WHEN x = 'PASS' AND y = 'PASS' THEN 'PASS' ELSE 'CONDITIONAL_PASS' END AS fnirs_raw_label FROM j),
q AS (SELECT *, eeg_label = 'FAIL' AND ppg_label = 'FAIL' AS both_bad, recording_label <> 'PASS' OR eeg_label <> 'PASS' OR ppg_label <> 'PASS' OR fnirs_raw_label <> 'PASS' OR g > {LIMITS['global']} AS part FROM k),
z AS (SELECT *, CASE WHEN short OR both_bad OR g > {LIMITS['global_fail']} THEN 'FAIL' WHEN part THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS first_label FROM q),
y AS (SELECT *, CASE WHEN first_label <> 'FAIL' AND uneven THEN 'CONDITIONAL_PASS' ELSE first_label END AS overall_session_label FROM z)
SELECT session_id, recording_label, eeg_label, ppg_label, fnirs_raw_label, 'NOT_ASSESSABLE' AS fnirs_hbo_hbr_readiness, round(g, 2) AS global_multimodal_artifact_percent, overall_session_label,
  CASE overall_session_label WHEN 'PASS' THEN 'included' WHEN 'CONDITIONAL_PASS' THEN 'included_after_cleaning' ELSE 'excluded_from_primary_analysis' END AS analysis_status,
  concat_ws(';', CASE WHEN short THEN 'longest_continuous_block_below_minimum' END, CASE WHEN gp THEN 'packet_gaps_detected' END, CASE WHEN dp THEN 'duplicate_packet_timestamps' END, CASE WHEN short THEN NULL WHEN both_bad THEN 'eeg_and_ppg_failed' WHEN g > {LIMITS['global_fail']} THEN 'severe_multimodal_artifact' WHEN part THEN 'usable_after_cleaning_or_partial_modality_limit' ELSE 'all_primary_qc_layers_passed' END, CASE WHEN first_label <> 'FAIL' AND uneven THEN 'large_eeg_channel_imbalance' END) AS reasons FROM y""")
def qc_session_decision(spark, sf):
    return rounded(D.session_decisions(decided(spark, sf), recordings(spark, sf, flagged(spark, sf)), LIMITS), "global_multimodal_artifact_percent", places=2)


def recordings(spark, sf, windows):
    """What is known of each session as a whole. Packets at half a minute's precision, so that some repeat."""
    p = packets(spark, sf).withColumn("t", F.floor(F.col("t") / 30000) * 30000)
    r = S.packet_stats(p, "session_id", "t", MOST_INTERVAL).select("session_id", F.col("n_long_intervals").alias("long_intervals"), F.col("n_duplicates").alias("duplicates"))
    r = r.join(p.groupBy("session_id").agg(((F.max("t") - F.min("t")) / 1000.0).alias("duration_seconds")), "session_id")
    g = S.global_artifacts(windows).groupBy("session_id", "window_index").agg(F.max("global_multimodal_artifact").alias("g"))
    g = g.groupBy("session_id").agg((F.avg(F.col("g").cast("double")) * 100).alias("global_artifact_percent"))
    rms = lambda s: F.sqrt(F.avg(F.when(F.col("signal") == s, F.col("value") * F.col("value"))))
    u = samples(spark, sf).groupBy("session_id").agg(rms("AF3").alias("a"), rms("AF4").alias("b")).select("session_id", (F.greatest("a", "b") / F.greatest(F.least("a", "b"), F.lit(1e-12))).alias("rms_ratio"))
    return r.join(g, "session_id", "left").join(u, "session_id", "left")


#: Rates at which the given series are long enough for windows of two seconds and the bands of their modalities.
RATES = {"eeg_fs": 24.0, "optical_fs": 10.0}
SIGNAL_LIMITS = {"duration": LIMITS["duration"], "missing": 4.0, "clipping": 30.0, "cv_fail": 120.0, "cv": 90.0, "valid_ibi_fail": 60.0, "valid_ibi": 75.0, "coupling_fail": -0.2, "coupling": 0.0}


def measured_signals(spark, sf):
    """Measures of filtered signals, and their windows; values are missing at every 37th event."""
    s = samples(spark, sf).withColumn("value", F.when(F.col("event_id") % 37 != 0, F.col("value")))
    filtered, beats, windows = M.session_windows(s, seconds=2.0, **RATES)
    return M.signal_measures(s, filtered, beats, windows, **RATES), windows


@query("qc_signals_measured")
def qc_signals_measured(spark, sf):
    d = D.signal_decisions(measured_signals(spark, sf)[0], F.col("modality"), SIGNAL_LIMITS)
    kinds = dict(d.dtypes)
    return rounded(d, *[c for c in d.columns if kinds[c] == "double"], places=4)


@query("qc_session_measured")
def qc_session_measured(spark, sf):
    """The whole way with measures of filtered signals; qc_session_decision decides by the same rules on measures of tables."""
    d, windows = measured_signals(spark, sf)
    return rounded(D.session_decisions(D.signal_decisions(d, F.col("modality"), SIGNAL_LIMITS), recordings(spark, sf, windows), SIGNAL_LIMITS), "global_multimodal_artifact_percent", places=2)


def _z(x: str, m: str) -> str:
    """The robust z of x about its median m in the window p: by the MAD, by the spread where that is 0, else 0."""
    return f"CASE WHEN median(abs({x} - {m})) OVER p > 0 THEN 0.67448975 * ({x} - {m}) / median(abs({x} - {m})) OVER p WHEN stddev_pop({x}) OVER p > 0 THEN ({x} - {m}) / stddev_pop({x}) OVER p ELSE 0 END"


BEATS = SQL + """, x AS (SELECT session_id, signal, sample_idx, value FROM s WHERE signal = 'PPG'), b AS (SELECT session_id, signal, sample_idx AS k FROM s WHERE signal = 'PPG' AND event_id % 4 = 0),
i AS (SELECT *, (k - lag(k) OVER (PARTITION BY session_id ORDER BY k)) / 10.0::DOUBLE AS g FROM b)"""


def beats(spark, sf):
    return samples(spark, sf).filter((F.col("signal") == "PPG") & (F.col("event_id") % 4 == 0)).select(*KEYS, F.col("sample_idx").alias("peak_idx"))


@query("pulse_windows", BEATS + """, n AS (SELECT session_id, signal, k // 20 AS w, count(*) AS n_peaks, avg(CASE WHEN g BETWEEN 0.4 AND 1.5 THEN 100.0::DOUBLE WHEN g IS NOT NULL THEN 0.0 END) AS v FROM i GROUP BY ALL),
w AS (SELECT session_id, signal, sample_idx // 20 AS w, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS ptp FROM x GROUP BY ALL HAVING count(*) = 20),
m AS (SELECT *, median(rms) OVER p AS a, median(ptp) OVER p AS b FROM w WINDOW p AS (PARTITION BY session_id, signal)), z AS (SELECT *, """ + _z("rms", "a") + " AS z_rms, " + _z("ptp", "b") + """ AS z_ptp FROM m WINDOW p AS (PARTITION BY session_id, signal)),
j AS (SELECT z.*, coalesce(n_peaks, 0) AS n_peaks, CASE WHEN n_peaks >= 3 THEN coalesce(v, 0) ELSE 0 END AS v FROM z LEFT JOIN n ON z.session_id = n.session_id AND z.w = n.w),
f AS (SELECT *, concat_ws(';', CASE WHEN z_rms > 2 OR rms > 12 * a THEN 'high_rms' END, CASE WHEN z_ptp > 2 OR ptp > 20 * b THEN 'high_peak_to_peak' END, CASE WHEN n_peaks NOT BETWEEN 1 AND 8 THEN 'implausible_peak_count' END) AS r FROM j)
SELECT session_id, signal, CAST(w AS BIGINT) AS window_index, round(rms, 6) AS rms, n_peaks, round(v, 6) AS valid_ibi_percent, r AS artifact_reason, r <> '' AS artifact FROM f""")
def pulse_windows(spark, sf):
    d = M.pulse_windows(samples(spark, sf).filter("signal = 'PPG'"), beats(spark, sf), fs=10.0, size=20, z=2.0)
    return rounded(d.select(*KEYS, "window_index", "rms", "n_peaks", "valid_ibi_percent", "artifact_reason", "artifact"), "rms", "valid_ibi_percent")


@query("pulse_measures", BEATS + """, v AS (SELECT *, CASE WHEN g BETWEEN 0.4 AND 1.5 THEN g END AS ok FROM i), d AS (SELECT session_id, k, ok - lag(ok) OVER (PARTITION BY session_id ORDER BY k) AS d FROM v WHERE ok IS NOT NULL)
SELECT v.session_id, v.signal, count(*) AS n_peaks, round(avg(CASE WHEN g IS NOT NULL THEN CASE WHEN ok IS NULL THEN 0.0 ELSE 100.0 END END), 6) AS valid_ibi_percent, round(median(60 / ok), 6) AS median_hr_bpm, round(stddev_pop(ok) / avg(ok) * 100, 6) AS ibi_cv_percent, round(sqrt(avg(d * d)) * 1000, 5) AS rmssd_ms FROM v LEFT JOIN d ON v.session_id = d.session_id AND v.k = d.k GROUP BY ALL""")
def pulse_measures(spark, sf):
    d = rounded(M.pulse_measures(beats(spark, sf), fs=10.0), "valid_ibi_percent", "median_hr_bpm", "ibi_cv_percent")
    return rounded(d, "rmssd_ms", places=5)


@query("optical_windows", SQL + """, x AS (SELECT session_id, signal, sample_idx, sample_idx // 10 AS w, CASE WHEN event_id % 7 <> 0 THEN value + 500 END AS raw, value - 3 AS f FROM s WHERE signal IN ('fNIRS_1', 'fNIRS_2')),
k AS (SELECT *, abs(raw - lag(raw) OVER o) / (sample_idx - lag(sample_idx) OVER o) AS st FROM x WHERE raw IS NOT NULL WINDOW o AS (PARTITION BY session_id, signal, w ORDER BY sample_idx)),
r AS (SELECT session_id, signal, w, avg(raw) AS mean, stddev_pop(raw) / abs(avg(raw)) * 100 AS cv, coalesce(max(st), 0) AS st FROM k GROUP BY ALL), a AS (SELECT session_id, signal, w, sqrt(avg(f * f)) AS rms, max(f) - min(f) AS ptp FROM x GROUP BY ALL HAVING count(*) = 10),
j AS (SELECT a.*, mean, cv, coalesce(st, 0) AS st FROM a LEFT JOIN r ON a.session_id = r.session_id AND a.signal = r.signal AND a.w = r.w), m AS (SELECT *, median(ptp) OVER p AS mp, median(st) OVER p AS ms FROM j WINDOW p AS (PARTITION BY session_id, signal)),
z AS (SELECT *, """ + _z("ptp", "mp") + " AS zp, " + _z("st", "ms") + """ AS zd FROM m WINDOW p AS (PARTITION BY session_id, signal))
SELECT session_id, signal, CAST(w AS BIGINT) AS window_index, round(mean, 6) AS raw_mean, round(cv, 6) AS raw_cv_percent, round(rms, 6) AS rms, round(ptp, 6) AS ptp, round(st, 6) AS max_first_difference, concat_ws(';', CASE WHEN w < 1 THEN 'setup' END, CASE WHEN zp > 2 THEN 'high_peak_to_peak' END, CASE WHEN zd > 2 THEN 'motion_step' END, CASE WHEN cv > 12 THEN 'high_local_cv' END) AS artifact_reason FROM z""")
def optical_windows(spark, sf):
    s = samples(spark, sf).filter(F.col("signal").isin("fNIRS_1", "fNIRS_2")).withColumn("filtered", F.col("value") - 3).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value") + 500))
    d = M.optical_windows(s, size=10, setup_windows=1, z=2.0, most_cv=12.0)
    return rounded(d, "raw_mean", "raw_cv_percent", "rms", "ptp", "max_first_difference").select(*KEYS, "window_index", "raw_mean", "raw_cv_percent", "rms", "ptp", "max_first_difference", "artifact_reason")


@query("channel_correlation", SQL + " SELECT a.session_id, round(corr(a.value, b.value), 6) AS correlation FROM s a JOIN s b ON a.session_id = b.session_id AND a.sample_idx = b.sample_idx AND a.signal = 'AF3' AND b.signal = 'AF4' GROUP BY 1")
def channel_correlation(spark, sf):
    return rounded(M.pair_correlation(samples(spark, sf), "AF3", "AF4", "value", "correlation"), "correlation")
