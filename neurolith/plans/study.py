"""Study queries: orders as sessions, customers as participants, line items as per-signal quality rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import kernels as K
from neurolith.operators import signal as S
from neurolith.operators import study as T
from neurolith.plans.fixtures import SQL, samples, table
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

MASTER = """WITH q AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS artifact, max(l_extendedprice) AS rms FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey AS session_id, max(CASE WHEN l_linenumber = 1 THEN artifact END) AS artifact_1, max(CASE WHEN l_linenumber = 2 THEN artifact END) AS artifact_2, max(CASE WHEN l_linenumber = 1 THEN rms END) / nullif(max(CASE WHEN l_linenumber = 2 THEN rms END), 0) AS eeg_rms_ratio FROM q GROUP BY 1),
o AS (SELECT o_orderkey AS session_id, o_custkey AS participant_key, CAST(1 + o_orderkey % 12 AS INT) AS study_day, CASE WHEN o_orderpriority = '5-LOW' THEN 'invalid_attempt' ELSE 'primary_valid' END AS session_role, o_orderpriority <> '4-NOT SPECIFIED' AS eligible,
  CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'CONDITIONAL_PASS' WHEN 'O' THEN 'PASS' END AS overall_label, CASE WHEN o_totalprice < 100000 THEN 'longest_continuous_block_below_minimum' ELSE 'severe_multimodal_artifact' END AS reasons, o_totalprice, o_orderdate FROM orders),
m AS (SELECT o.*, artifact_1, artifact_2, eeg_rms_ratio, CASE WHEN NOT eligible THEN 'EXCLUDED_L1' WHEN overall_label IS NULL THEN 'L2_NOT_RUN' WHEN overall_label = 'FAIL' THEN CASE WHEN contains(reasons, 'longest_continuous_block_below_minimum') THEN 'EXCLUDED_L2_DURATION' ELSE 'EXCLUDED_L2_SIGNAL' END
  WHEN overall_label = 'CONDITIONAL_PASS' THEN 'INCLUDED_CONDITIONAL' WHEN overall_label = 'PASS' THEN 'INCLUDED' ELSE 'UNKNOWN' END AS final_label FROM o LEFT JOIN p USING (session_id))"""


def sessions(spark, sf):
    o = table(spark, sf, "orders")
    overall = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "CONDITIONAL_PASS").when(F.col("o_orderstatus") == "O", "PASS")
    return o.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("participant_key"), (1 + F.col("o_orderkey") % 12).cast("int").alias("study_day"),
        F.when(F.col("o_orderpriority") == "5-LOW", "invalid_attempt").otherwise("primary_valid").alias("session_role"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("analysis_eligible"),
        overall.alias("overall_label"), F.when(F.col("o_totalprice") < 100000, "longest_continuous_block_below_minimum").otherwise("severe_multimodal_artifact").alias("reasons"), "o_totalprice", "o_orderdate",
    )


def master(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("artifact"), F.max("l_extendedprice").alias("rms"))
    q = T.pivot_quality(rows, "l_orderkey", "l_linenumber", [1, 2], ["artifact", "rms"], F.col("artifact"))
    q = q.select(F.col("l_orderkey").alias("session_id"), F.col("1_artifact").alias("artifact_1"), F.col("2_artifact").alias("artifact_2"), (F.col("1_rms") / F.nullif(F.col("2_rms"), F.lit(0.0))).alias("eeg_rms_ratio"))
    return T.master_sessions(sessions(spark, sf), q)


@query("master_sessions", MASTER + "SELECT session_id, participant_key, study_day, session_role, overall_label, final_label, artifact_1, artifact_2, round(eeg_rms_ratio, 6) AS eeg_rms_ratio FROM m")
def master_sessions(spark, sf):
    return rounded(master(spark, sf).select("session_id", "participant_key", "study_day", "session_role", "overall_label", "final_label", "artifact_1", "artifact_2", "eeg_rms_ratio"), "eeg_rms_ratio")


@query("final_label_counts", MASTER + "SELECT final_label, count(*) AS n FROM m GROUP BY 1")
def final_label_counts(spark, sf):
    return master(spark, sf).groupBy("final_label").agg(F.count(F.lit(1)).alias("n"))


SUMMARY = MASTER + """,
u AS (SELECT participant_key, count(*) AS total_sessions, count(*) FILTER (session_role = 'primary_valid') AS primary_valid_sessions, count(*) FILTER (session_role = 'invalid_attempt') AS invalid_attempt_sessions,
  count(DISTINCT CASE WHEN session_role = 'primary_valid' THEN study_day END) AS days_attempted, count(DISTINCT CASE WHEN final_label IN ('INCLUDED', 'INCLUDED_CONDITIONAL') THEN study_day END) AS days_included, count(DISTINCT CASE WHEN final_label = 'INCLUDED' THEN study_day END) AS days_pass_only,
  avg(CASE WHEN session_role = 'primary_valid' THEN CASE WHEN overall_label = 'FAIL' THEN 1.0 ELSE 0.0 END END) * 100 AS fail_rate_percent, count(*) FILTER (final_label IN ('EXCLUDED_L2_SIGNAL', 'EXCLUDED_L2_DURATION')) AS any_excluded_l2, list_sort(list(DISTINCT study_day)) AS days FROM m GROUP BY 1),
us AS (SELECT *, CASE WHEN days_attempted > 0 THEN list_filter(range(list_min(days), list_max(days) + 1), lambda x: NOT list_contains(days, x)) ELSE [] END AS gone FROM u)"""


@query("participant_summary", SUMMARY + "SELECT participant_key, total_sessions, primary_valid_sessions, invalid_attempt_sessions, days_attempted, days_included, days_pass_only, round(fail_rate_percent, 6) AS fail_rate_percent, any_excluded_l2, CASE WHEN days_attempted > 0 THEN round_even(days_included / days_attempted * 100, 1) END AS yield_percent, array_to_string(days, ',') AS study_days_covered, array_to_string(gone, ',') AS missing_days FROM us")
def participant_summary(spark, sf):
    s = T.participant_summary(master(spark, sf))
    return rounded(s.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("study_days_covered", "missing_days")}), "fail_rate_percent")


_LABELS = {
    "eeg_label": "CASE WHEN o_totalprice < 60000 THEN 'FAIL' WHEN o_totalprice < 150000 THEN 'PASS' END", "ppg_label": "CASE WHEN study_day % 4 = 0 THEN 'FAIL' ELSE 'PASS' END",
    "participant_name": "'P' || participant_key", "group_name": "CASE WHEN study_day % 3 = 0 THEN 'A' WHEN study_day % 3 = 1 THEN 'B' END",
}


@query("participant_report", SUMMARY + f""", lb AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _LABELS.items())} FROM m), gr AS (SELECT participant_key, group_name, count(*) AS n FROM lb WHERE group_name IS NOT NULL GROUP BY participant_key, group_name QUALIFY row_number() OVER (PARTITION BY participant_key ORDER BY count(*) DESC, group_name) = 1),
ra AS (SELECT participant_key, min(participant_name) AS participant_name, avg(CASE WHEN session_role = 'primary_valid' THEN CASE WHEN eeg_label = 'FAIL' THEN 1.0 ELSE 0.0 END END) * 100 AS eeg, avg(CASE WHEN session_role = 'primary_valid' THEN CASE WHEN ppg_label = 'FAIL' THEN 1.0 ELSE 0.0 END END) * 100 AS ppg FROM lb GROUP BY 1)
SELECT participant_key, participant_name, group_name, total_sessions, days_attempted, days_included, round(eeg, 6) AS eeg_fail_rate_percent, round(ppg, 6) AS ppg_fail_rate_percent, CAST(NULL AS DOUBLE) AS fnirs_fail_rate_percent FROM us JOIN ra USING (participant_key) LEFT JOIN gr USING (participant_key)""")
def participant_report(spark, sf):
    m = master(spark, sf).withColumns({c: F.expr(x) for c, x in _LABELS.items()})
    d = T.participant_report(m).select("participant_key", "participant_name", "group_name", "total_sessions", "days_attempted", "days_included", *T.FAIL_RATES.values())
    return rounded(d, "eeg_fail_rate_percent", "ppg_fail_rate_percent")


@query("quality_with_identity", MASTER + """, qf AS (SELECT 'f' || l_orderkey AS File, max(l_quantity) AS percent_kept, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
SELECT participant_key, study_day, session_id, File, percent_kept, round(total, 2) AS total FROM qf LEFT JOIN (SELECT participant_key, study_day, session_id FROM m WHERE session_role = 'primary_valid') i ON File = 'f' || session_id""")
def quality_with_identity(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("File")).agg(F.max("l_quantity").alias("percent_kept"), F.sum("l_extendedprice").alias("total"))
    i = sessions(spark, sf).filter("session_role = 'primary_valid'").select(F.concat(F.lit("f"), F.col("session_id").cast("string")).alias("File"), "participant_key", "study_day", "session_id")
    return rounded(T.with_identity(q, i), "total", places=2)


@query("participant_medians", MASTER + "SELECT participant_key, count(*) AS n, round(median(o_totalprice), 4) AS median_o_totalprice, round(median(eeg_rms_ratio), 6) AS median_eeg_rms_ratio FROM m GROUP BY 1")
def participant_medians(spark, sf):
    return rounded(rounded(T.participant_medians(master(spark, sf), "participant_key", ["o_totalprice", "eeg_rms_ratio"]), "median_o_totalprice", places=4), "median_eeg_rms_ratio")


@query("session_folders", MASTER + """, wd AS (SELECT c_custkey AS participant_key, d AS study_day FROM customer, range(1, 13) t(d)), la AS (SELECT participant_key, study_day, max(session_id) AS session_id FROM m GROUP BY ALL)
SELECT wd.participant_key, CAST(wd.study_day AS INT) AS study_day, session_id, CASE WHEN session_id IS NOT NULL THEN printf('layer2/participant=%d/study_day=%02d/session_id=%d', wd.participant_key, wd.study_day, session_id) END AS folder FROM wd LEFT JOIN la ON wd.participant_key = la.participant_key AND wd.study_day = la.study_day""")
def session_folders(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("participant_key"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("study_day"))
    return T.session_folders(wanted, sessions(spark, sf), "layer2")


@query("study_day_summary", MASTER + "SELECT study_day, count(*) AS total_sessions, count(DISTINCT participant_key) AS n_participants, count(*) FILTER (final_label IN ('INCLUDED', 'INCLUDED_CONDITIONAL')) AS n_included, round(avg(CASE WHEN session_role = 'primary_valid' THEN CASE WHEN overall_label = 'FAIL' THEN 1.0 ELSE 0.0 END END) * 100, 6) AS fail_rate_percent, round(avg(CASE WHEN session_role = 'primary_valid' THEN CASE WHEN overall_label = 'PASS' THEN 1.0 ELSE 0.0 END END) * 100, 6) AS pass_rate_percent FROM m GROUP BY 1")
def study_day_summary(spark, sf):
    return rounded(T.study_day_summary(master(spark, sf)), "fail_rate_percent", "pass_rate_percent")


@query("analysis_roster", MASTER + ", d AS (SELECT participant_key FROM m WHERE final_label IN ('INCLUDED', 'INCLUDED_CONDITIONAL') GROUP BY 1 HAVING count(DISTINCT study_day) >= 4) SELECT participant_key, study_day, session_id, final_label FROM m WHERE final_label IN ('INCLUDED', 'INCLUDED_CONDITIONAL') AND participant_key IN (SELECT participant_key FROM d)")
def analysis_roster(spark, sf):
    return T.roster(master(spark, sf), 4).select("participant_key", "study_day", "session_id", "final_label")


@query("review_flags", SUMMARY + """,
x AS (SELECT *, final_label IN ('EXCLUDED_L1', 'EXCLUDED_L2_DURATION', 'EXCLUDED_L2_SIGNAL') AS ex FROM m), y AS (SELECT *, lead(ex) OVER w AS nx, lead(study_day) OVER w AS nd FROM x WINDOW w AS (PARTITION BY participant_key ORDER BY study_day, session_id)),
z AS (SELECT * FROM y WHERE ex AND nx QUALIFY row_number() OVER (PARTITION BY participant_key ORDER BY study_day, session_id) = 1)
SELECT DISTINCT * FROM (SELECT final_label AS flag_type, CASE final_label WHEN 'EXCLUDED_L2_SIGNAL' THEN 'HIGH' ELSE 'LOW' END AS priority, participant_key, study_day, session_id, reasons AS detail FROM m WHERE final_label IN ('EXCLUDED_L2_SIGNAL', 'EXCLUDED_L2_DURATION')
UNION ALL SELECT 'CONSECUTIVE_EXCLUSIONS', 'HIGH', participant_key, study_day, NULL, 'Day ' || study_day || ' and ' || nd || ' both excluded' FROM z
UNION ALL SELECT 'MISSING_DAYS', 'MEDIUM', participant_key, NULL, NULL, 'Missing days: [' || array_to_string(gone, ', ') || ']' FROM us WHERE len(gone) > 0
UNION ALL SELECT 'EEG_CHANNEL_IMBALANCE', 'MEDIUM', participant_key, study_day, session_id, printf('EEG RMS ratio = %.1f', eeg_rms_ratio) FROM m WHERE eeg_rms_ratio > 10)""")
def review_flags(spark, sf):
    m = master(spark, sf)
    return T.review_flags(m, T.participant_summary(m))


@query("tier1_latest", MASTER + "SELECT participant_key, study_day, session_id, final_label FROM m QUALIFY row_number() OVER (PARTITION BY participant_key ORDER BY study_day DESC, session_id DESC) = 1")
def tier1_latest(spark, sf):
    return T.latest(master(spark, sf), "participant_key", ["study_day", "session_id"], ["study_day", "session_id", "final_label"])


@query("tier2_spearman", MASTER + """, r AS (SELECT participant_key, rank() OVER (PARTITION BY participant_key ORDER BY study_day) + (count(*) OVER (PARTITION BY participant_key, study_day) - 1) / 2 AS a, rank() OVER (PARTITION BY participant_key ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY participant_key, o_totalprice) - 1) / 2 AS b FROM m)
SELECT participant_key, count(*) AS n_pairs, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) + 0.0 END AS rho FROM r GROUP BY 1""")
def tier2_spearman(spark, sf):
    return rounded(T.spearman(master(spark, sf), ["participant_key"], "study_day", "o_totalprice"), "rho").withColumn("rho", F.col("rho") + F.lit(0.0))


@query("tier3_reference", MASTER + ", a AS (SELECT participant_key, median(o_totalprice) AS own FROM m GROUP BY 1) SELECT participant_key, round(own, 4) AS own, round((SELECT median(own) FROM a), 4) AS population, round(own - (SELECT median(own) FROM a), 4) AS difference FROM a")
def tier3_reference(spark, sf):
    own = master(spark, sf).groupBy("participant_key").agg(F.median("o_totalprice").alias("own"))
    d = own.crossJoin(F.broadcast(own.agg(F.median("own").alias("population"))))  # one row on the right
    return rounded(d.withColumn("difference", F.col("own") - F.col("population")), "own", "population", "difference", places=4)


@query("composite_zscore", "WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3 FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((l_quantity - m1) / s1 - (l_discount - m2) / s2 + (l_tax - m3) / s3) / 3, 5) AS composite FROM lineitem, s")
def composite_zscore(spark, sf):
    d = T.composite(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"], {"l_discount": -1}, 3)
    return rounded(d.drop("l_quantity", "l_discount", "l_tax"), "composite", places=5)


@query("bh_fdr", "WITH t AS (SELECT p_partkey, p_brand, ((p_partkey * 7919) % 10007) / 10007.0::DOUBLE AS p FROM part), r AS (SELECT *, count(p) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS k FROM t) SELECT p_partkey, p_brand, round(p, 8) AS p, round(least(1.0, min(p * n / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 8) AS q, least(1.0, min(p * n / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM r")
def bh_fdr(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_brand", (((F.col("p_partkey") * 7919) % 10007) / F.lit(10007.0)).alias("p"))
    return rounded(T.benjamini_hochberg(t, ["p_brand"], "p"), "p", "q", places=8)


_BINS = SQL + ", n AS (SELECT *, count(*) OVER (PARTITION BY session_id, signal) AS n FROM s), b AS (SELECT session_id, signal, (SELECT max(k) FROM range(20) t(k) WHERE k * n // 20 <= sample_idx) AS bin, value, sample_idx FROM n), c AS (SELECT session_id, signal, bin, median(value) AS y, median(sample_idx) AS x FROM b GROUP BY ALL)"


@query("theil_sen_slope", _BINS + ", p AS (SELECT a.session_id, a.signal, median((b.y - a.y) / (b.x - a.x)) AS slope FROM c a JOIN c b ON a.session_id = b.session_id AND a.signal = b.signal AND a.x < b.x GROUP BY ALL), m AS (SELECT session_id, signal, median(x) AS mx, median(y) AS my FROM c GROUP BY ALL) SELECT session_id, signal, round(slope, 6) AS slope, round(my - slope * mx, 5) AS intercept FROM p JOIN m USING (session_id, signal)")
def theil_sen_slope(spark, sf):
    b = S.even_bins(samples(spark, sf), 20)
    d = T.theil_sen(b, ["session_id", "signal"], "place", "value")
    return rounded(rounded(d, "slope"), "intercept", places=5)


@query("zero_phase_filter")
def zero_phase_filter(spark, sf):
    return K.band_pass(samples(spark, sf), ["session_id", "signal"], fs=100.0, low=0.5, high=8.0, order=3)


@query("welch_bands")
def welch_bands(spark, sf):
    return K.welch_bands(samples(spark, sf), ["session_id", "signal"], fs=100.0)


@query("tddr")
def tddr(spark, sf):
    return K.tddr(samples(spark, sf), ["session_id", "signal"], fs=10.0)


def _series(spark, sf):
    return samples(spark, sf).withColumn("series", F.concat_ws("/", F.col("session_id").cast("string"), "signal"))


@query("ppg_hrv")
def ppg_hrv(spark, sf):
    """Pulse intervals of 0.30 to 1.80 s between prominent peaks, and their measures; series without any are flagged."""
    at = K.series_peaks(_series(spark, sf), ["series"], fs=25.0, chain="ppg", apart=0.35, prominent=True, least_seconds=1.5)
    return at.select("series").distinct().join(X.hrv(X.intervals(at.filter("at IS NOT NULL"), "series", "at", 1.0, 0.30, 1.80), "series", "at"), "series", "left").fillna({"n_ibi": 0, "quality_flag": "NO_VALID_IBI"})


@query("ppg_resp")
def ppg_resp(spark, sf):
    """Breath intervals of 2 to 10 s, their rate and variation; series of less than 30 s or without breaths are flagged."""
    at = K.series_peaks(_series(spark, sf), ["series"], fs=4.0, chain="respiration", apart=2.0, prominent=False, least_seconds=30.0)
    return at.select("series").distinct().join(X.breathing(X.intervals(at.filter("at IS NOT NULL"), "series", "at", 1.0, 2.0, 10.0), "series"), "series", "left").fillna({"n_bbi": 0, "quality_flag": "NO_VALID_BREATHS"})


@query("plv_coherence")
def plv_coherence(spark, sf):
    return K.phase_locking(samples(spark, sf), "AF3", "AF4", fs=100.0, low=8.0, high=13.0)


@query("lmm_random_intercept")
def lmm_random_intercept(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return K.random_intercept(rows, "g", "x", "y")


@query("lmm_batch")
def lmm_batch(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    return K.batch_random_intercepts(rows, "l_suppkey", [("l_quantity", "l_extendedprice"), ("l_discount", "l_extendedprice"), ("l_discount", "l_quantity")])


@query("optical_unpack", "WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice AS value, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS row_idx, l_returnflag AS k FROM lineitem), n AS (SELECT *, max(row_idx) OVER () + 1 AS n FROM r) SELECT row_idx, (row_idx // 244) * 100 + row_idx % 244 AS sample_idx, value FROM n WHERE row_idx % 244 < 100 AND row_idx // 244 < n // 244")
def optical_unpack(spark, sf):
    from neurolith.sources.recordings import numbered, unpack_optical

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    r, n = numbered(table(spark, sf, "lineitem").select(*order), order)
    return unpack_optical(r, [], n=F.lit(n)).select("row_idx", "sample_idx", F.col("l_extendedprice").alias("value"))


@query("ingest_numeric", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE) AS x FROM events")
def ingest_numeric(spark, sf):
    from neurolith.sources.recordings import numeric

    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return table(spark, sf, "events").select("event_id", numeric(text).alias("x"))


@query("sidecar_json")
def sidecar_json(spark, sf):
    from neurolith.sources.recordings import sidecar

    return sidecar(samples(spark, sf), "session_id", 244.0)
