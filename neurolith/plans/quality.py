"""Signal quality queries over the sample stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import signal as S
from neurolith.plans.fixtures import SQL, samples
from neurolith.plans.registry import query

SIZE = 10
LIMITS = {"z_rms": 3.0, "z_ptp": 3.0, "z_kurtosis": 8.0, "rms_ratio": 12.0, "ptp_ratio": 20.0, "high_fraction": 0.15}

WINDOWS = SQL + """,
w0 AS (SELECT session_id, signal, CAST(floor(sample_idx / 10) AS BIGINT) AS window_index, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS ptp, max(abs(value)) AS max_abs,
    avg(CASE WHEN abs(value) > 150 THEN 1.0 ELSE 0.0 END) AS high_fraction, kurtosis(value) + 3 AS kurtosis FROM s GROUP BY ALL HAVING count(*) = 10),
w1 AS (SELECT *, median(rms) OVER p AS m_rms, median(ptp) OVER p AS m_ptp, median(kurtosis) OVER p AS m_kurtosis FROM w0 WINDOW p AS (PARTITION BY session_id, signal)),
w2 AS (SELECT *, 0.67448975 * (rms - m_rms) / median(abs(rms - m_rms)) OVER p AS z_rms, 0.67448975 * (ptp - m_ptp) / median(abs(ptp - m_ptp)) OVER p AS z_ptp,
    0.67448975 * (kurtosis - m_kurtosis) / median(abs(kurtosis - m_kurtosis)) OVER p AS z_kurtosis, rms / greatest(m_rms, 1e-12) AS rms_ratio, ptp / greatest(m_ptp, 1e-12) AS ptp_ratio FROM w1 WINDOW p AS (PARTITION BY session_id, signal)),
f AS (SELECT *, concat_ws(';', CASE WHEN z_rms > 3 OR rms_ratio > 12 THEN 'high_rms' END, CASE WHEN z_ptp > 3 OR ptp_ratio > 20 THEN 'high_peak_to_peak' END,
    CASE WHEN z_kurtosis > 8 THEN 'high_kurtosis' END, CASE WHEN high_fraction > 0.15 THEN 'high_amplitude_uv' END) AS artifact_reason FROM w2),
fl AS (SELECT *, artifact_reason <> '' AS artifact FROM f)"""
LABELS = WINDOWS + """,
sl AS (SELECT *, CASE WHEN artifact_percent > 30 THEN 'FAIL' WHEN artifact_percent > 10 OR dyn > 20 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS label,
    CASE WHEN artifact_percent > 30 THEN 'severe_recurrent_artifact' WHEN artifact_percent > 10 OR dyn > 20 THEN 'moderate_artifact_burden' ELSE 'acceptable_qc_metrics' END AS reason
    FROM (SELECT session_id, signal, count(*) AS n_windows, avg(CASE WHEN artifact THEN 1.0 ELSE 0.0 END) * 100 AS artifact_percent, quantile_cont(rms, 0.95) / greatest(median(rms), 1e-9) AS dyn FROM fl GROUP BY ALL)),
gw AS (SELECT session_id, window_index, count(DISTINCT CASE WHEN artifact THEN signal END) AS n_signals_artifact FROM fl GROUP BY ALL),
gp AS (SELECT session_id, avg(CASE WHEN n_signals_artifact >= 3 THEN 1.0 ELSE 0.0 END) * 100 AS global_artifact_percent FROM gw GROUP BY ALL)"""


def flagged(spark, sf):
    return S.flag_windows(S.window_table(samples(spark, sf), SIZE), **LIMITS)


def labels(spark, sf):
    return S.signal_labels(flagged(spark, sf), 30.0, 10.0, 20.0)


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("qc_window_table", WINDOWS + "SELECT session_id, signal, window_index, round(rms, 6) AS rms, round(ptp, 6) AS ptp, round(kurtosis, 5) AS kurtosis, round(max_abs, 6) AS max_abs, round(high_fraction, 6) AS high_fraction, round(z_rms, 5) AS z_rms, round(rms_ratio, 5) AS rms_ratio, artifact, artifact_reason FROM fl")
def qc_window_table(spark, sf):
    d = flagged(spark, sf).select("session_id", "signal", "window_index", "rms", "ptp", "kurtosis", "max_abs", "high_fraction", "z_rms", "rms_ratio", "artifact", "artifact_reason")
    return rounded(rounded(d, "rms", "ptp", "max_abs", "high_fraction"), "kurtosis", "z_rms", "rms_ratio", places=5)


@query("qc_signal_summary", LABELS + "SELECT session_id, signal, n_windows, round(artifact_percent, 6) AS artifact_percent, round(dyn, 6) AS dyn, label, reason FROM sl")
def qc_signal_summary(spark, sf):
    return rounded(labels(spark, sf), "artifact_percent", "dyn")


@query("qc_session_label", LABELS + """,
d AS (SELECT session_id, max(CASE WHEN signal = 'AF3' THEN label END) AS a, max(CASE WHEN signal = 'AF4' THEN label END) AS b, max(CASE WHEN signal = 'PPG' THEN label END) AS p, max(CASE WHEN signal = 'fNIRS_1' THEN label END) AS x, max(CASE WHEN signal = 'fNIRS_2' THEN label END) AS y FROM sl GROUP BY 1),
e AS (SELECT session_id, CASE WHEN a = 'FAIL' OR b = 'FAIL' THEN 'FAIL' WHEN a = 'CONDITIONAL_PASS' OR b = 'CONDITIONAL_PASS' THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS eeg_label, coalesce(p, 'NOT_ASSESSABLE') AS ppg_label,
    CASE WHEN x = 'FAIL' AND y = 'FAIL' THEN 'FAIL' WHEN x = 'PASS' AND y = 'PASS' THEN 'PASS' ELSE 'CONDITIONAL_PASS' END AS fnirs_label, global_artifact_percent AS g FROM d LEFT JOIN gp USING (session_id)),
o AS (SELECT *, CASE WHEN (eeg_label = 'FAIL' AND ppg_label = 'FAIL') OR g > 30 THEN 'FAIL' WHEN eeg_label <> 'PASS' OR ppg_label <> 'PASS' OR fnirs_label <> 'PASS' OR g > 10 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS overall_label FROM e)
SELECT session_id, eeg_label, ppg_label, fnirs_label, round(g, 6) AS global_artifact_percent, overall_label,
    CASE WHEN eeg_label = 'FAIL' AND ppg_label = 'FAIL' THEN 'eeg_and_ppg_failed' WHEN g > 30 THEN 'severe_multimodal_artifact' WHEN overall_label = 'CONDITIONAL_PASS' THEN 'usable_after_cleaning_or_partial_modality_limit' ELSE 'all_primary_qc_layers_passed' END AS reasons,
    CASE overall_label WHEN 'PASS' THEN 'included' WHEN 'CONDITIONAL_PASS' THEN 'included_after_cleaning' ELSE 'excluded_from_primary_analysis' END AS analysis_status FROM o""")
def qc_session_label(spark, sf):
    f = flagged(spark, sf)
    g = S.global_artifacts(f).groupBy("session_id", "window_index").agg(F.max("global_multimodal_artifact").alias("g"))
    g = g.groupBy("session_id").agg((F.avg(F.col("g").cast("double")) * 100).alias("global_artifact_percent"))
    return rounded(S.session_labels(S.signal_labels(f, 30.0, 10.0, 20.0), g, 30.0, 10.0), "global_artifact_percent")


@query("qc_global_artifact", LABELS + "SELECT fl.session_id, signal, fl.window_index, artifact, n_signals_artifact, n_signals_artifact >= 3 AS global_multimodal_artifact FROM fl JOIN gw USING (session_id, window_index)")
def qc_global_artifact(spark, sf):
    return S.global_artifacts(flagged(spark, sf)).select("session_id", "signal", "window_index", "artifact", "n_signals_artifact", "global_multimodal_artifact")


@query("qc_artifact_intervals", WINDOWS + """,
a AS (SELECT *, CASE WHEN window_index > lag(window_index) OVER (PARTITION BY session_id, signal ORDER BY window_index) + 1 THEN 1 ELSE 0 END AS n FROM fl WHERE artifact),
b AS (SELECT *, sum(n) OVER (PARTITION BY session_id, signal ORDER BY window_index) AS i FROM a)
SELECT session_id, signal, min(window_index) AS start_window, max(window_index) + 1 AS end_window, array_to_string(list_sort(list_distinct(flatten(list(string_split(artifact_reason, ';'))))), ';') AS reason FROM b GROUP BY session_id, signal, i""")
def qc_artifact_intervals(spark, sf):
    return S.merge_intervals(flagged(spark, sf))


PACKETS = "WITH e AS (SELECT CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS session_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS gap FROM e), m AS (SELECT session_id, 5 * median(gap) AS most FROM d GROUP BY 1)"


def packets(spark, sf):
    s = spark.read.parquet(f"{sf}/events.parquet")
    return s.select(F.floor((F.dayofmonth("ts") - 1) / 5).alias("session_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"))


def _blocks(spark, sf):
    p = packets(spark, sf)
    gap = p.withColumn("_d", F.col("t") - F.lag("t").over(S.by("session_id", order="t")))
    most = gap.groupBy("session_id").agg((5 * F.median("_d")).alias("most"))
    return S.split_blocks(p.join(most, "session_id"), ("session_id",), "t", F.col("most"))


BLOCKS = PACKETS + ", b AS (SELECT d.session_id, t, CAST(sum(CASE WHEN gap > most THEN 1 ELSE 0 END) OVER (PARTITION BY d.session_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS BIGINT) AS block_id FROM d JOIN m ON d.session_id = m.session_id), n AS (SELECT session_id, block_id, count(*) AS n_rows, max(t) - min(t) AS span_ms FROM b GROUP BY ALL)"


@query("qc_block_split", BLOCKS + " SELECT * FROM n")
def qc_block_split(spark, sf):
    return _blocks(spark, sf).groupBy("session_id", "block_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("t") - F.min("t")).alias("span_ms"))


@query("qc_longest_block", BLOCKS + " SELECT session_id, block_id, n_rows FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n_rows DESC, block_id) = 1")
def qc_longest_block(spark, sf):
    return S.longest_block(_blocks(spark, sf), ("session_id",))


@query("qc_packet_stats", PACKETS + " SELECT session_id, count(*) AS n_packets, median(gap) AS median_interval, min(gap) AS min_interval, max(gap) AS max_interval, count(t) - count(DISTINCT t) AS n_duplicates, count(*) FILTER (gap > 1500000) AS n_long_intervals FROM d GROUP BY 1")
def qc_packet_stats(spark, sf):
    return S.packet_stats(packets(spark, sf), "session_id", "t", 1_500_000)


@query("qc_flatline_runs", SQL + """,
r AS (SELECT *, CASE WHEN abs(round(value / 50) - lag(round(value / 50)) OVER (PARTITION BY session_id, signal ORDER BY sample_idx)) <= 0 THEN 1 ELSE 0 END AS same FROM s),
i AS (SELECT *, sum(1 - same) OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS run FROM r),
n AS (SELECT session_id, signal, run, sum(same) AS n FROM i GROUP BY ALL)
SELECT session_id, signal, CASE WHEN max(n) > 0 THEN (max(n) + 1) / 100.0::DOUBLE ELSE 0.0 END AS longest_flatline_seconds FROM n GROUP BY ALL""")
def qc_flatline_runs(spark, sf):
    return S.longest_flatline(samples(spark, sf).withColumn("value", F.round(F.col("value") / 50)), 100.0)


@query("qc_clipping", SQL + ", m AS (SELECT session_id, signal, min(round(value)) AS lo, max(round(value)) AS hi FROM s GROUP BY ALL) SELECT session_id, signal, round(avg(CASE WHEN round(value) = lo OR round(value) = hi THEN 1.0 ELSE 0.0 END) * 100, 6) AS clipping_percent FROM s JOIN m USING (session_id, signal) GROUP BY ALL")
def qc_clipping(spark, sf):
    return rounded(S.clipping_percent(samples(spark, sf).withColumn("value", F.round("value"))), "clipping_percent")


@query("qc_overview_start", WINDOWS + ", g AS (SELECT session_id, window_index, avg(CASE WHEN artifact THEN 1.0 ELSE 0.0 END) AS a FROM fl GROUP BY ALL), h AS (SELECT *, max(window_index) OVER (PARTITION BY session_id) + 1 AS n FROM g) SELECT session_id, window_index AS start_window FROM h WHERE window_index + 2 <= n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY a, window_index) = 1")
def qc_overview_start(spark, sf):
    return S.overview_start(flagged(spark, sf), 2)


GAPS = SQL + ", g AS (SELECT session_id, signal, sample_idx, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM s)"


def gappy(spark, sf):
    return samples(spark, sf).select("session_id", "signal", "sample_idx", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query("gap_fill_linear", GAPS + """,
h AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN value IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1 FROM g
  WINDOW a AS (PARTITION BY session_id, signal ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY session_id, signal ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session_id, signal, sample_idx, round(coalesce(value, v0 + (v1 - v0) * (sample_idx - i0) / (i1 - i0), v0, v1, 0.0), 6) AS filled FROM h""")
def gap_fill_linear(spark, sf):
    return rounded(S.fill_linear(gappy(spark, sf)).select("session_id", "signal", "sample_idx", "filled"), "filled")


@query("gap_fill_median", GAPS + "SELECT session_id, signal, sample_idx, round(coalesce(value, median(value) OVER (PARTITION BY session_id, signal)), 6) AS filled FROM g")
def gap_fill_median(spark, sf):
    return rounded(S.fill_median(gappy(spark, sf)).select("session_id", "signal", "sample_idx", "filled"), "filled")


@query("adc_to_uv", "SELECT event_id, round((value * 100000 - 8388608.0) * 1e6 * 2.4 / 8388608.0 / 2, 4) AS uv FROM events")
def adc_to_uv(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.round(S.adc_to_uv(F.col("value") * 100000), 4).alias("uv"))


@query("moving_mean_zero_pad", SQL + "SELECT session_id, signal, sample_idx, round((coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3, 6) AS smoothed FROM s WINDOW w AS (PARTITION BY session_id, signal ORDER BY sample_idx)")
def moving_mean_zero_pad(spark, sf):
    return rounded(S.moving_mean(samples(spark, sf)).select("session_id", "signal", "sample_idx", "smoothed"), "smoothed")


@query("rolling_median", SQL + "SELECT session_id, signal, sample_idx, CASE WHEN count(value) OVER w >= 3 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS rolling_median FROM s WINDOW w AS (PARTITION BY session_id, signal ORDER BY sample_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def rolling_median(spark, sf):
    return rounded(S.rolling_median(samples(spark, sf), 9).select("session_id", "signal", "sample_idx", "rolling_median"), "rolling_median")


@query("downsample_bins", SQL + ", n AS (SELECT *, CAST(floor(sample_idx / ceil(count(*) OVER (PARTITION BY session_id, signal) / 60)) AS BIGINT) AS bin FROM s) SELECT session_id, signal, bin, round(avg(value), 6) AS value, count(value) AS n FROM n GROUP BY ALL")
def downsample_bins(spark, sf):
    return rounded(S.downsample(samples(spark, sf), 60), "value")


@query("linspace_bins", SQL + ", n AS (SELECT *, count(*) OVER (PARTITION BY session_id, signal) AS n FROM s), b AS (SELECT *, (SELECT max(k) FROM range(20) t(k) WHERE k * n // 20 <= sample_idx) AS bin FROM n) SELECT session_id, signal, CAST(bin AS BIGINT) AS bin, round(median(value), 6) AS value, median(sample_idx) AS place FROM b GROUP BY ALL")
def linspace_bins(spark, sf):
    return rounded(S.even_bins(samples(spark, sf), 20), "value")


BASE = SQL + ", bl AS (SELECT session_id, signal, median(value) AS baseline FROM s GROUP BY ALL), sm AS (SELECT s.session_id, s.signal, sample_idx, baseline, (coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3 AS smoothed FROM s JOIN bl ON s.session_id = bl.session_id AND s.signal = bl.signal WINDOW w AS (PARTITION BY s.session_id, s.signal ORDER BY sample_idx))"


def baseline(s):
    return s.groupBy("session_id", "signal").agg(F.median("value").alias("baseline"))


@query("relax_onset", BASE + ", o AS (SELECT *, CASE WHEN min(smoothed) OVER w >= baseline AND count(*) OVER w = 3 THEN sample_idx END AS hit FROM sm WINDOW w AS (PARTITION BY session_id, signal ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT session_id, signal, count(*) AS n_epochs, min(hit) AS onset_idx, min(hit) IS NOT NULL AS onset_reached, min(hit) * 2.0::DOUBLE AS onset_seconds FROM o GROUP BY ALL")
def relax_onset(spark, sf):
    s = samples(spark, sf)
    return S.sustained_onset(s, baseline(s), 3, 2.0)


@query("drowsy_run", BASE + """, o AS (SELECT *, CASE WHEN smoothed > baseline * 1.5 THEN 1 ELSE 0 END AS up FROM sm), r AS (SELECT *, sum(1 - up) OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS run FROM o),
n AS (SELECT session_id, signal, run, count(*) AS n, sum(up) AS len, min(CASE WHEN up = 1 THEN sample_idx END) AS st FROM r GROUP BY ALL)
SELECT session_id, signal, round(100.0 * sum(len) OVER p / sum(n) OVER p, 6) AS percent_above, CASE WHEN len > 0 THEN st END AS longest_start, len * 2.0::DOUBLE AS longest_seconds FROM n WINDOW p AS (PARTITION BY session_id, signal) QUALIFY row_number() OVER (PARTITION BY session_id, signal ORDER BY len DESC, st) = 1""")
def drowsy_run(spark, sf):
    s = samples(spark, sf)
    return rounded(S.longest_above(s, baseline(s), 1.5, 2.0), "percent_above")


@query("distraction_gaps", SQL + ", k AS (SELECT *, sample_idx - lag(sample_idx) OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS d FROM s WHERE value < 150) SELECT session_id, signal, count(*) AS n_kept, count(*) FILTER (d > 1.5) AS n_gaps, CAST(coalesce(sum(CASE WHEN d > 1.5 THEN d - 1 END), 0) AS BIGINT) AS n_missing FROM k GROUP BY ALL")
def distraction_gaps(spark, sf):
    return S.epoch_gaps(samples(spark, sf).filter("value < 150"), 1.0)
