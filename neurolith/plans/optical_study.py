"""Queries of the optical study: tiers of flags, measures of segments, and the run over all sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import optical_study as O
from neurolith.operators.features import PHASES
from neurolith.plans.fixtures import table
from neurolith.plans.haemodynamics import EVENTS, optical
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

_FLAGS = "concat_ws(';', CASE WHEN value > 150 THEN 'SATURATION' END, CASE WHEN event_id % 11 = 0 THEN 'ROBUST_OUTLIER' END, CASE WHEN event_id % 13 = 0 THEN 'INVALID_BASELINE' END, CASE WHEN event_id % 7 = 0 THEN 'PHASE_OVERLAP' END, CASE WHEN event_id % 17 = 0 THEN 'EMPTY_FILE' END, CASE WHEN event_id % 5 = 0 THEN 'OF_NO_TIER' END)"


def _any(names: tuple[str, ...]) -> str:
    return "list_has_any(l, [" + ", ".join(f"'{n}'" for n in names) + "])"


@query("flag_tiers", f"WITH f AS (SELECT event_id, {_FLAGS} AS flags FROM events), s AS (SELECT *, list_filter(list_distinct(string_split(flags, ';')), lambda x: x <> '') AS l FROM f) SELECT event_id, flags, CAST(len(l) AS INT) AS qc_flag_count, "
       + ", ".join(f"{_any(names)} AS has_{t}_flag" for t, names in O.TIERS.items()) + ", NOT (" + " OR ".join(_any(names) for t, names in O.TIERS.items() if t != "stat") + ") AS qc_pass FROM s")
def flag_tiers(spark, sf):
    return O.flag_tiers(table(spark, sf, "events").select("event_id", F.expr(_FLAGS).alias("flags")), "flags")


@query("flag_counts", f"SELECT qc_flag, count(*) AS n_rows FROM (SELECT unnest(string_split({_FLAGS}, ';')) AS qc_flag FROM events) WHERE qc_flag <> '' GROUP BY 1")
def flag_counts(spark, sf):
    return O.flag_counts(table(spark, sf, "events").select(F.expr(_FLAGS).alias("flags")), "flags")


MEASURES = [f"{s}_{m}" for s in ("hbo", "hbr", "hbt") for m in ("mean_uM", "sd_uM", "slope_uM_per_min", "peak_to_peak_uM", "max_uM", "min_uM")]


def _measures(s: str) -> str:
    f = f"FILTER (signal = '{s}')"
    return f"avg(v) {f} AS {s}_mean_uM, stddev_samp(v) {f} AS {s}_sd_uM, regr_slope(v, t / 60.0::DOUBLE) {f} AS {s}_slope_uM_per_min, max(v) {f} - min(v) {f} AS {s}_peak_to_peak_uM, max(v) {f} AS {s}_max_uM, min(v) {f} AS {s}_min_uM"


_SEGMENTS = EVENTS + f""", x AS (SELECT l.session_id, phase AS segment, signal, value AS v, sample_idx - a AS t FROM l JOIN ev ON l.session_id = ev.session_id AND sample_idx >= a AND sample_idx < b),
g AS (SELECT session_id, segment, CAST(count(*) FILTER (signal = 'hbo') AS DOUBLE) AS segment_duration_s, count(*) FILTER (signal = 'hbo') AS n_samples, {", ".join(map(_measures, ("hbo", "hbr", "hbt")))} FROM x GROUP BY ALL),
w AS (SELECT session_id, segment, t, v, unnest([t // 8, t // 8 - 1]) AS s FROM x WHERE signal = 'hbo'), m AS (SELECT *, t - 8 * s AS j, avg(v) OVER k AS mu, count(*) OVER k AS c FROM w WHERE s >= 0 WINDOW k AS (PARTITION BY session_id, segment, s)),
f AS (SELECT session_id, segment, s, q, sum((v - mu) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * q * j / 16)) AS re, sum((v - mu) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * q * j / 16)) AS im FROM m, range(0, 9) r(q) WHERE c = 16 GROUP BY ALL),
p AS (SELECT session_id, segment, q, avg(re * re + im * im) * CASE WHEN q IN (0, 8) THEN 1 ELSE 2 END AS p FROM f GROUP BY session_id, segment, q),
r AS (SELECT session_id, segment, (sum(p) FILTER (q BETWEEN 1 AND 4) - sum(p) FILTER (q IN (1, 4)) / 2) / (sum(p) FILTER (q BETWEEN 1 AND 8) - sum(p) FILTER (q IN (1, 8)) / 2) AS ratio FROM p GROUP BY ALL)
SELECT session_id, segment, segment_duration_s, n_samples, {", ".join(f"round({m}, 5) + 0.0 AS {m}" for m in MEASURES)}, segment_duration_s AS freq_domain_duration_s, round(ratio, 6) AS low_freq_power_ratio FROM g LEFT JOIN r USING (session_id, segment)"""


def _phases(spark, sf):
    """The optical signals as concentrations, and thirds of each session as phases."""
    c = optical(spark, sf, "hbo", "hbr").withColumn("hbt", F.col("hbo") + F.col("hbr"))
    n = c.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    third = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(k).alias("k")) for k, p in enumerate(PHASES)]))
    ev = n.withColumn("_p", third).select("session_id", "_p.phase", F.floor(F.col("n") * F.col("_p.k") / 3).alias("start_idx"), F.floor(F.col("n") * (F.col("_p.k") + 1) / 3).alias("stop_idx"))
    return c, ev


@query("haemo_segment_measures", _SEGMENTS)
def haemo_segment_measures(spark, sf):
    c, ev = _phases(spark, sf)
    d = O.segment_measures(c, ev.withColumnRenamed("phase", "segment"), ["session_id"], fs=1.0, cutoff=None, seconds=16.0, low=(0.0625, 0.25), total=(0.0625, 0.5))
    return rounded(rounded(d, *MEASURES, places=5), "low_freq_power_ratio", places=6)


def _study(spark, sf) -> dict:
    """The study over the given sessions: the second one has no events, the fourth one no samples."""
    c, ev = _phases(spark, sf)
    folder = F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("folder")
    c = c.filter("session_id <> 3").select(folder, "sample_idx", "hbo", "hbr", "hbt")
    flag = F.when(F.col("session_id") == 3, "MISSING_FILE").otherwise("")
    sessions = ev.select("session_id").distinct().select(folder, F.when(F.col("session_id") != 3, "concentration_fallback").alias("input_signal_stage"), flag.alias("input_qc_flags"))
    events = ev.filter("session_id NOT IN (1, 3)").select(folder, "phase", F.col("start_idx").cast("double").alias("start_s"), (F.col("stop_idx") - F.col("start_idx")).cast("double").alias("duration_s"))
    valid = sessions.select("folder", F.lit("").alias("flags"))
    before = c.groupBy("folder").agg(F.count(F.lit(1)).alias("n_samples_before"))
    return O.study_tables(c, sessions, valid, events, before, O.Settings(fs=1.0, bins=20, least_third=9.0, window=16.0, step=8.0, low_band=(0.0625, 0.25), total_band=(0.0625, 0.5)))


@query("optical_study_log", EVENTS + """, rest AS (SELECT c.session_id, stddev_pop(hbo) AS sd FROM c JOIN ev ON c.session_id = ev.session_id AND phase = 'REST_BEFORE' AND sample_idx < b AND sample_idx >= greatest(a, b - 30) AND b - a >= 10 GROUP BY 1),
cm AS (SELECT *, median(hbo) OVER (PARTITION BY session_id) AS m FROM c), mad AS (SELECT session_id, 1.4826 * median(abs(hbo - m)) AS mad FROM cm GROUP BY 1)
SELECT 's' || nn.session_id AS folder, CASE WHEN session_id = 3 THEN 'NO_INPUT_DATA' ELSE 'OK' END AS status, CASE WHEN session_id <> 3 THEN n END AS n_samples_after,
  CASE session_id WHEN 3 THEN 'MISSING_FILE' WHEN 1 THEN 'MISSING_BASELINE;MISSING_PHASE' ELSE concat_ws(';', CASE WHEN sd > 3 * mad OR mad <= 1e-9 THEN 'BASELINE_HIGH_VARIABILITY' END, CASE WHEN n // 3 < 10 THEN 'INVALID_BASELINE' END, CASE WHEN sd IS NULL THEN 'MISSING_BASELINE' END) END AS session_qc_flags
FROM nn LEFT JOIN rest USING (session_id) LEFT JOIN mad USING (session_id)""")
def optical_study_log(spark, sf):
    return _study(spark, sf)["run_log"].select("folder", "status", "n_samples_after", "session_qc_flags")


@query("optical_study_phases", EVENTS + """, x AS (SELECT l.session_id, phase, l.signal, value FROM l JOIN ev ON l.session_id = ev.session_id AND sample_idx >= a AND sample_idx < b WHERE l.session_id NOT IN (1, 3) UNION ALL SELECT session_id, 'OVERALL', signal, value FROM l WHERE session_id = 1)
SELECT 's' || session_id AS folder, phase, signal, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(stddev_samp(value), 5) AS sd, count(*) AS n FROM x GROUP BY ALL""")
def optical_study_phases(spark, sf):
    """Full phases of all sessions; those without events as a whole."""
    d = _study(spark, sf)["phase_by_phase"].filter("variant = 'full_phase' AND phase IN ('REST_BEFORE', 'MEDITATION', 'REST_AFTER', 'OVERALL')")
    return rounded(d.select("folder", "phase", "signal", "mean", "median", "sd", F.round("valid_seconds").cast("long").alias("n")), "mean", "median", "sd", places=5)
