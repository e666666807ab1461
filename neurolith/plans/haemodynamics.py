"""Queries of the optical chain, phase metrics, and heart and breath series over the sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import chain as A
from neurolith.operators import haemodynamics as H
from neurolith.operators import tables as B
from neurolith.operators import vitals as L
from neurolith.operators.features import PHASES
from neurolith.plans.fixtures import SQL, phases, samples, table
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

KEYS = ["session_id", "signal"]


@query("time_base_checks", """WITH t AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS DOUBLE) AS t, event_id FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS dt FROM t),
g AS (SELECT user_id, count(*) AS n_samples, 1 / median(CASE WHEN dt > 0 THEN dt END) AS fs, count(CASE WHEN dt <= 0 THEN 1 END) AS back, count(CASE WHEN dt = 0 THEN 1 END) AS same FROM d GROUP BY 1)
SELECT user_id, n_samples, round(fs, 8) AS sampling_rate_hz, concat_ws(';', CASE WHEN back > 0 THEN 'NON_MONOTONIC_TIME' END, CASE WHEN same > 0 THEN 'DUPLICATED_TIMESTAMP' END, CASE WHEN coalesce(abs(fs - 0.05) > 0.04, true) THEN 'INVALID_SAMPLING_RATE' END) AS input_qc_flags FROM g""")
def time_base_checks(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.timestamp_diff("HOUR", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts")).cast("double").alias("t"))
    return rounded(H.time_checks(e, ["user_id"], "t", ["event_id"], expected_fs=0.05, most_off=0.04), "sampling_rate_hz", places=8)


@query("robust_detrend", SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY session_id, signal) AS n FROM s), b AS (SELECT session_id, signal, (SELECT max(k) FROM range(20) t(k) WHERE k * n // 20 <= sample_idx) AS bin, value, sample_idx FROM n),
c AS (SELECT session_id, signal, bin, median(value) AS y, median(sample_idx) AS x FROM b GROUP BY ALL), p AS (SELECT a.session_id, a.signal, median((b.y - a.y) / (b.x - a.x)) AS slope FROM c a JOIN c b ON a.session_id = b.session_id AND a.signal = b.signal AND a.x < b.x GROUP BY ALL),
m AS (SELECT session_id, signal, median(x) AS mx, median(y) AS my FROM c GROUP BY ALL)
SELECT session_id, signal, sample_idx, round(value - (slope * sample_idx + my - slope * mx), 5) + 0.0 AS value FROM s JOIN p USING (session_id, signal) JOIN m USING (session_id, signal)""")
def robust_detrend(spark, sf):
    d = samples(spark, sf).select(*KEYS, "sample_idx", "value").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    out = H.linear_detrended(d, KEYS, ["value"], bins=20)
    return out.select(*KEYS, "sample_idx", (F.round("value", 5) + 0.0).alias("value"))


def optical(spark, sf, a: str, b: str) -> DataFrame:
    """The two optical signals side by side, at the places that both have."""
    s = samples(spark, sf).filter(F.col("signal").isin("fNIRS_1", "fNIRS_2"))
    at = lambda name, out: F.max(F.when(F.col("signal") == name, F.col("value"))).alias(out)
    return s.groupBy("session_id", "sample_idx").agg(at("fNIRS_1", a), at("fNIRS_2", b)).dropna(subset=[a, b])


@query("haemoglobin_chain")
def haemoglobin_chain(spark, sf):
    """Density, repair, 0.2 Hz low-pass, concentrations and robust detrending; the repair and filters are no SQL."""
    d = H.preprocess(optical(spark, sf, "i740", "i850"), ["session_id"], fs=2.0)
    return rounded(d, "hbo", "hbr", "hbt", "weight_a", "weight_b")


@query("haemoglobin_rolling")
def haemoglobin_rolling(spark, sf):
    """Concentrations as they come, without a repair, low-passed, less their rolling median."""
    d = H.preprocess(optical(spark, sf, "hbo", "hbr"), ["session_id"], fs=2.0, stage="concentration", repair=False, detrend="rolling", window_seconds=30.0)
    return rounded(d.drop("weight_a", "weight_b"), "hbo", "hbr", "hbt")


@query("motion_summary")
def motion_summary(spark, sf):
    return rounded(H.motion_fractions(H.preprocess(optical(spark, sf, "i740", "i850"), ["session_id"], fs=2.0, lowpass=None, detrend=None), ["session_id"], 0.9), "motion_fraction_1", "motion_fraction_2")


EVENTS = SQL + """, c AS (SELECT session_id, sample_idx, max(CASE WHEN signal = 'fNIRS_1' THEN value END) AS hbo, max(CASE WHEN signal = 'fNIRS_2' THEN value END) AS hbr FROM s GROUP BY ALL HAVING hbo IS NOT NULL AND hbr IS NOT NULL),
nn AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1), ev AS (SELECT session_id, phase, n * k // 3 AS a, n * (k + 1) // 3 AS b FROM nn, (VALUES (0, 'REST_BEFORE'), (1, 'MEDITATION'), (2, 'REST_AFTER')) t(k, phase)),
sg AS (SELECT session_id, phase, 'full_phase' AS variant, a, b FROM ev UNION ALL SELECT session_id, phase, 'stable_phase', least(b, a + CASE phase WHEN 'MEDITATION' THEN 4 ELSE 2 END), b FROM ev),
l AS (SELECT session_id, sample_idx, signal, value FROM (SELECT session_id, sample_idx, hbo, hbr, hbo + hbr AS hbt FROM c) UNPIVOT (value FOR signal IN (hbo, hbr, hbt))),
bl AS (SELECT l.session_id, l.signal, median(value) AS baseline FROM l JOIN ev ON l.session_id = ev.session_id AND phase = 'REST_BEFORE' AND sample_idx >= a AND sample_idx < b WHERE l.session_id <> 2 GROUP BY ALL)"""


def _session(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The optical signals as concentrations, thirds of each session as phases in two variants, and baselines but for session 2."""
    c = optical(spark, sf, "hbo", "hbr").withColumn("hbt", F.col("hbo") + F.col("hbr"))
    n = c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    third = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(k).alias("k")) for k, p in enumerate(PHASES)]))
    ev = n.withColumn("_p", third).select("session_id", "_p.phase", F.floor(F.col("n") * F.col("_p.k") / 3).alias("start_idx"), F.floor(F.col("n") * (F.col("_p.k") + 1) / 3).alias("stop_idx"))
    segments = B.phase_segments(ev, 1.0, exclusion={"MEDITATION": 4.0}, otherwise=2.0, least_seconds=92.0)
    rest = B.in_segments(c, ev.filter("phase = 'REST_BEFORE' AND session_id <> 2"), ["session_id"])
    baseline = rest.unpivot(["session_id"], list(H.SIGNALS), "signal", "value").groupBy("session_id", "signal").agg(F.median("value").alias("baseline"))
    return c, segments, baseline


METRICS = ["mean", "median", "sd", "mad", "iqr", "ptp", "min", "max", "trimmed10", "slope_per_min", "auc", "valid_seconds", "robust_slope_per_min", "finite_fraction", *[f"{m}_delta" for m in (*H.SHIFTED, "auc")]]


def places(metric: str) -> int:
    """Decimals to compare by: a MAD of hundredths has seven, and must not be cut at a half."""
    return 8 if metric == "mad" else 5


@query("haemo_phase_metrics", EVENTS + """, x AS (SELECT l.session_id, phase, variant, l.signal, value, sample_idx, sample_idx - a AS place, b - a AS sz FROM l JOIN sg ON l.session_id = sg.session_id AND sample_idx >= a AND sample_idx < b),
q AS (SELECT *, median(value) OVER k AS m, count(*) OVER k AS n, row_number() OVER (k ORDER BY value, sample_idx) AS r, lag(value) OVER (k ORDER BY sample_idx) AS prev FROM x WINDOW k AS (PARTITION BY session_id, phase, variant, signal)),
pf AS (SELECT session_id, phase, variant, signal, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd, 1.4826 * median(abs(value - m)) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, max(value) - min(value) AS ptp, min(value) AS min, max(value) AS max,
  avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN value END) AS trimmed10, regr_slope(value, sample_idx / 60.0::DOUBLE) AS slope_per_min, sum((value + prev) / 2) AS auc, CAST(count(value) AS DOUBLE) AS valid_seconds FROM q GROUP BY ALL),
tb AS (SELECT session_id, phase, variant, signal, (SELECT max(k) FROM range(20) t(k) WHERE k * sz // 20 <= place) AS bin, value, place FROM x), tc AS (SELECT session_id, phase, variant, signal, bin, median(value) AS y, median(place) AS xx FROM tb GROUP BY ALL),
tp AS (SELECT p.session_id, p.phase, p.variant, p.signal, median((o.y - p.y) / (o.xx - p.xx)) * 60 AS robust_slope_per_min FROM tc p JOIN tc o ON p.session_id = o.session_id AND p.phase = o.phase AND p.variant = o.variant AND p.signal = o.signal AND p.xx < o.xx GROUP BY ALL),
z AS (SELECT pf.*, CASE WHEN valid_seconds >= 4 THEN robust_slope_per_min END AS robust_slope_per_min, 1.0::DOUBLE AS finite_fraction, mean - baseline AS mean_delta, median - baseline AS median_delta, trimmed10 - baseline AS trimmed10_delta, min - baseline AS min_delta, max - baseline AS max_delta, auc - baseline * (valid_seconds - 1) AS auc_delta FROM pf LEFT JOIN bl USING (session_id, signal) LEFT JOIN tp USING (session_id, phase, variant, signal))
SELECT session_id, phase, variant, signal, """ + ", ".join(f'round("{m}", {places(m)}) + 0.0 AS "{m}"' for m in METRICS) + " FROM z")
def haemo_phase_metrics(spark, sf):
    c, segments, baseline = _session(spark, sf)
    d = H.phase_metrics(c, segments, baseline, ["session_id"], fs=1.0, bins=20)
    return d.select("session_id", "phase", "variant", "signal", *[(F.round(m, places(m)) + 0.0).alias(m) for m in METRICS])


@query("haemo_segment_flags", EVENTS + """ SELECT session_id, phase, variant, a AS start_idx, b AS stop_idx, CAST(b - a AS DOUBLE) AS duration_seconds, 0.0::DOUBLE AS hbt_residual,
concat_ws(';', CASE WHEN b - a < 92 THEN 'DURATION_MISMATCH' END, CASE WHEN session_id = 2 THEN 'MISSING_BASELINE' END) AS qc_flags FROM sg""")
def haemo_segment_flags(spark, sf):
    return rounded(H.segment_flags(*_session(spark, sf), ["session_id"]), "hbt_residual")


@query("haemo_low_ratio")
def haemo_low_ratio(spark, sf):
    """The share of low frequencies of each segment's hbo; windowed_low_ratio has the SQL twin of what it calls."""
    c, segments, _ = _session(spark, sf)
    return rounded(H.segment_low_ratio(c, segments, ["session_id"], fs=1.0, seconds=16, step_seconds=8, low=(0.05, 0.2), total=(0.05, 0.5)), "low_freq_power_ratio")


@query("drowsiness_series", SQL + """, e AS (SELECT session_id, sample_idx // 8 AS epoch, phase, signal AS channel, avg(value) AS theta, max(value) AS alpha FROM ph WHERE signal IN ('AF3', 'AF4') GROUP BY ALL),
g AS (SELECT session_id, epoch, phase, CASE WHEN avg(alpha) > 0 THEN avg(theta) / avg(alpha) END AS ratio FROM e GROUP BY ALL),
b AS (SELECT session_id, CASE WHEN count(CASE WHEN phase = 'REST_BEFORE' THEN ratio END) >= 3 THEN median(CASE WHEN phase = 'REST_BEFORE' THEN ratio END) END AS baseline FROM g GROUP BY 1)
SELECT session_id, epoch, phase, round(ratio, 6) AS ratio, round(baseline, 6) AS baseline FROM g JOIN b USING (session_id)""")
def drowsiness_series(spark, sf):
    p = phases(spark, sf).filter(F.col("signal").isin("AF3", "AF4"))
    e = p.groupBy("session_id", F.floor(F.col("sample_idx") / 8).alias("epoch"), "phase", F.col("signal").alias("channel")).agg(F.avg("value").alias("theta"), F.max("value").alias("alpha"))
    return rounded(H.ratio_series(e, "session_id", F.col("theta"), F.col("alpha")), "ratio", "baseline")


def _ppg(spark, sf, fs: float) -> tuple[DataFrame, DataFrame]:
    """The PPG signal, and its phases in seconds."""
    p = phases(spark, sf).filter("signal = 'PPG'")
    ev = p.groupBy("session_id", "phase").agg((F.min("sample_idx") / fs).alias("start_s"), ((F.max("sample_idx") + 1) / fs).alias("stop_s"))
    return p, ev


@query("ppg_hrv_segments")
def ppg_hrv_segments(spark, sf):
    """Heart measures of the whole session, of each phase and of windows of the middle one; every segment has a row."""
    p, ev = _ppg(spark, sf, 25.0)
    d = L.segment_hrv(p, B.session_segments(ev, "session_id", seconds=2.0), "session_id", fs=25.0)
    return rounded(d, "hr_bpm", "rmssd_ms", "sdrr_ms", "prr50", "prr20", "seconds")


@query("ppg_hr_series")
def ppg_hr_series(spark, sf):
    p, ev = _ppg(spark, sf, 25.0)
    d = L.segment_hrv(p, L.window_segments(ev, "session_id", 3.0), "session_id", fs=25.0)
    return L.window_series(d, "session_id", {"hr_bpm": "hr", "rmssd_ms": "rmssd"})


@query("resp_series")
def resp_series(spark, sf):
    p, ev = _ppg(spark, sf, 2.0)
    d = L.segment_breathing(p, L.window_segments(ev, "session_id", 35.0), "session_id", fs=2.0)
    return L.window_series(d, "session_id", {"resp_rate": "resp_rate"})


def _chain(spark, sf) -> dict[str, DataFrame]:
    o = A.Settings(fs=25.0, include=("AF3", "AF4"), line_frequency=10.0, line_window=2.0, highpass=0.5, lowpass=9.0, least_correlation=None, wavelet_block=None, epoch=1.0, most_amplitude=400.0, most_surprisal_sd=2.0)
    return A.run(samples(spark, sf), o)


@query("cleaning_chain")
def cleaning_chain(spark, sf):
    """The quality row of every recording after a whole run of the cleaning chain."""
    return rounded(_chain(spark, sf)["quality"], "percent_good", "percent_kept")


@query("cleaned_epochs")
def cleaned_epochs(spark, sf):
    e = _chain(spark, sf)["epochs"]
    return e.select("session_id", "channel", "epoch", F.round("max_abs", 5).alias("max_abs"), "rejected")
