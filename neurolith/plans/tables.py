"""Queries of study tables: lookups, reshapes, phases, windows and personal summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import signal as S
from neurolith.operators import study as T
from neurolith.operators import tables as B
from neurolith.plans.fixtures import SQL, phases, samples, table
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query
from neurolith.plans.study import MASTER, master

PHASES = ", ".join(f"'{p}'" for p in X.PHASES)
KEYS = ["session_id", "signal"]


@query("column_families", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_brand LIKE 'Brand#1%'")
def column_families(spark, sf):
    d = table(spark, sf, "part").filter(F.col("p_brand").startswith("Brand#1"))
    return B.in_front(B.present(d, ["p_size", "absent", *B.matching(d, "price$", "key$"), "p_brand"]), ["p_partkey", "p_brand"])


@query("clipped_scores", "SELECT event_id, round(greatest(0, least(100, value - 50)), 6) AS score, round((value * 100000 - 8388608.0) * 2.4 / 8388608.0 / 2, 8) AS volts, round(value * 1e6 * 2.4 / 8388608.0 / 2, 6) AS scaled_uv, round(ln(greatest(value - 100, 1e-8)), 6) AS safe_log FROM events")
def clipped_scores(spark, sf):
    e, v = table(spark, sf, "events"), F.col("value")
    return e.select("event_id", F.round(B.clipped_percent(v - 50), 6).alias("score"), F.round(B.adc_to_volts(v * 100000), 8).alias("volts"), F.round(B.adc_scaled(v), 6).alias("scaled_uv"), F.round(F.ln(F.greatest(v - 100, F.lit(1e-8))), 6).alias("safe_log"))


@query("ordered_reasons", "WITH r AS (SELECT event_id, list_filter([CASE WHEN value > 100 THEN 'high' END, CASE WHEN event_id % 3 = 0 THEN 'third' END, CASE WHEN value > 150 THEN 'high' END, CASE WHEN event_id % 5 = 0 THEN 'fifth' END], lambda x: x IS NOT NULL) AS l FROM events) SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS reasons FROM r")
def ordered_reasons(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select("event_id", B.distinct_reasons(F.when(v > 100, "high"), F.when(i % 3 == 0, "third"), F.when(v > 150, "high"), F.when(i % 5 == 0, "fifth")).alias("reasons"))


@query("optional_join", MASTER + ", hq AS (SELECT l_orderkey AS session_id, CAST(max(l_tax) AS DOUBLE) AS variance FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) SELECT m.session_id, variance, CAST(NULL AS VARCHAR) AS absent FROM m LEFT JOIN hq USING (session_id)")
def optional_join(spark, sf):
    q = table(spark, sf, "lineitem").filter("l_linenumber = 3").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.max("l_tax").alias("variance"))
    return B.join_optional(master(spark, sf).select("session_id"), q, ["session_id"], {"variance": "double", "absent": "string"})


@query("role_lookup", MASTER + ", k AS (SELECT *, CASE session_role WHEN 'primary_valid' THEN 0 WHEN 'repeat' THEN 1 ELSE 99 END AS role_rank FROM m) SELECT participant_key, study_day, session_id, role_rank, last_value(final_label) OVER (PARTITION BY participant_key, study_day ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_label FROM k QUALIFY row_number() OVER (PARTITION BY participant_key, study_day ORDER BY role_rank, session_id) = 1")
def role_lookup(spark, sf):
    m = master(spark, sf).withColumn("role_rank", B.rank_of(F.col("session_role"), ["primary_valid", "repeat"]))
    day = ["participant_key", "study_day"]
    first = B.preferred(m, day, [F.col("role_rank"), F.col("session_id")]).select(*day, "session_id", "role_rank")
    return first.join(B.last_of(m, day, [F.col("session_id")], ["final_label"]).withColumnRenamed("final_label", "last_label"), day)


@query("samples_in_phases", SQL + ", g AS (SELECT session_id, signal, phase, min(sample_idx) + 2 AS a, max(sample_idx) - 1 AS b FROM ph GROUP BY ALL) SELECT g.session_id, g.signal, g.phase, count(*) AS n, round(avg(value), 6) AS mean FROM s JOIN g ON s.session_id = g.session_id AND s.signal = g.signal AND sample_idx >= a AND sample_idx < b GROUP BY ALL")
def samples_in_phases(spark, sf):
    g = phases(spark, sf).groupBy(*KEYS, "phase").agg((F.min("sample_idx") + 2).alias("start_idx"), (F.max("sample_idx") - 1).alias("stop_idx"))
    d = B.in_segments(samples(spark, sf).select(*KEYS, "sample_idx", "value"), g, KEYS)
    return rounded(d.groupBy(*KEYS, "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@query("participant_day_grid", MASTER + ", c AS (SELECT * FROM (SELECT DISTINCT participant_key FROM m), (SELECT DISTINCT study_day FROM m)) SELECT c.participant_key, c.study_day, f.final_label FROM c LEFT JOIN (SELECT participant_key, study_day, final_label FROM m QUALIFY row_number() OVER (PARTITION BY participant_key, study_day ORDER BY session_id) = 1) f ON c.participant_key = f.participant_key AND c.study_day = f.study_day")
def participant_day_grid(spark, sf):
    return B.grid(master(spark, sf), "participant_key", "study_day", "final_label", [F.col("session_id")])


@query("describe_metrics", "WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_tax]) AS x FROM lineitem) SELECT metric, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, max(x) AS max FROM l GROUP BY 1")
def describe_metrics(spark, sf):
    return rounded(B.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), "mean", "std", "q25", "q50", "q75", places=4)


@query("group_mode_first", MASTER + ", c AS (SELECT participant_key, final_label, count(*) AS n FROM m GROUP BY ALL), f AS (SELECT participant_key, final_label AS first_label FROM m QUALIFY row_number() OVER (PARTITION BY participant_key ORDER BY session_id) = 1), d AS (SELECT participant_key, median(o_totalprice) AS p FROM m GROUP BY 1) SELECT c.participant_key, c.final_label AS mode_label, first_label, round(p, 4) AS median_price FROM c JOIN f USING (participant_key) JOIN d USING (participant_key) QUALIFY row_number() OVER (PARTITION BY c.participant_key ORDER BY n DESC, c.final_label) = 1")
def group_mode_first(spark, sf):
    g = master(spark, sf).groupBy("participant_key").agg(F.mode("final_label", True).alias("mode_label"), F.min_by("final_label", "session_id").alias("first_label"), F.median("o_totalprice").alias("median_price"))
    return rounded(g, "median_price", places=4).orderBy("median_price", "participant_key")


@query("run_counters", "WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS pre, count(*) FILTER (l_quantity < 25) AS post, count(*) FILTER (l_tax < 0.04) AS ok FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(sum(pre) AS BIGINT) AS n_total, CAST(sum(ok) AS BIGINT) AS n_ok, round(sum(ok) * 100.0::DOUBLE / sum(pre), 6) AS percent_ok, string_agg(l_linestatus || '=' || pre, ',' ORDER BY l_linestatus) AS pre, string_agg(l_linestatus || '=' || post, ',' ORDER BY l_linestatus) AS post FROM p GROUP BY 1")
def run_counters(spark, sf):
    d = B.run_counts(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_tax") < 0.04, "l_linestatus", F.col("l_quantity") < 25)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rounded(d.withColumns({"pre": text("pre"), "post": text("post")}), "percent_ok")


@query("trial_average", "WITH e AS (SELECT vec_id % 7 AS condition, unnest(range(len(embedding))) AS time_idx, unnest(embedding) AS x FROM embeddings) SELECT condition, CAST(time_idx AS INT) AS time_idx, round(avg(CAST(x AS DOUBLE)), 6) AS average, count(x) AS n_epochs FROM e GROUP BY ALL")
def trial_average(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("condition"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(B.trial_average(e, ["condition"], "x"), "average")


FLAT = SQL + ", g AS (SELECT session_id, signal, sample_idx, CASE WHEN event_id % 7 <> 0 THEN round(value / 50) END AS value FROM s), r AS (SELECT *, CASE WHEN value <> lag(value) OVER w THEN 1 WHEN lag(value) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM g WHERE value IS NOT NULL WINDOW w AS (PARTITION BY session_id, signal ORDER BY sample_idx)), i AS (SELECT *, sum(n) OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS run FROM r), c AS (SELECT session_id, signal, run, count(*) AS k FROM i GROUP BY ALL), fl AS (SELECT session_id, signal, CASE WHEN max(k) > 1 THEN max(k) / 100.0::DOUBLE ELSE 0.0 END AS max_flat_seconds FROM c GROUP BY ALL)"


def coarse(spark, sf):
    return samples(spark, sf).select(*KEYS, "sample_idx", F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") / 50)).alias("value"))


@query("max_flat_run", FLAT + " SELECT * FROM fl")
def max_flat_run(spark, sf):
    return B.longest_flat_run(coarse(spark, sf), KEYS, 100.0)


@query("signal_validity", FLAT + ", v AS (SELECT *, median(value) OVER p AS m FROM g WINDOW p AS (PARTITION BY session_id, signal)), y AS (SELECT *, median(abs(value - m)) OVER p AS mad, stddev_pop(value) OVER p AS sd FROM v WINDOW p AS (PARTITION BY session_id, signal)), z AS (SELECT *, CASE WHEN mad > 0 THEN 0.67448975 * (value - m) / mad WHEN sd > 0 THEN (value - m) / sd ELSE 0 END AS z FROM y), k AS (SELECT session_id, signal, count(value) / count(*) AS ff, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END) FILTER (value IS NOT NULL) AS sat FROM z GROUP BY ALL) SELECT session_id, signal, round(ff, 6) AS finite_fraction, round(sat, 6) AS saturated_fraction, max_flat_seconds, concat_ws(';', CASE WHEN ff < 0.86 THEN 'HIGH_NAN_RATIO' END, CASE WHEN max_flat_seconds >= 0.12 THEN 'FLAT_SIGNAL' END, CASE WHEN sat > 0.04 THEN 'SATURATION' END) AS flags FROM k JOIN fl USING (session_id, signal)")
def signal_validity(spark, sf):
    d = B.signal_validity(coarse(spark, sf), KEYS, 100.0, least_finite=0.86, most_flat=0.12, most_z=2.0, most_saturated=0.04)
    return rounded(d, "finite_fraction", "saturated_fraction")


EVENTS = SQL + ", ev AS (SELECT session_id, phase, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS stop_idx FROM ph WHERE signal = 'AF3' GROUP BY ALL)"


def events(spark, sf):
    return phases(spark, sf).filter("signal = 'AF3'").groupBy("session_id", "phase").agg(F.min("sample_idx").alias("start_idx"), (F.max("sample_idx") + 1).alias("stop_idx"))


@query("phase_segments", EVENTS + ", v AS (SELECT session_id, phase, 'full_phase' AS variant, start_idx, stop_idx FROM ev UNION ALL SELECT session_id, phase, 'stable_phase', least(stop_idx, start_idx + CASE phase WHEN 'MEDITATION' THEN 15 ELSE 5 END), stop_idx FROM ev) SELECT *, CAST(stop_idx - start_idx AS DOUBLE) AS duration_seconds, CASE WHEN stop_idx - start_idx < 100 THEN 'DURATION_MISMATCH' END AS flag FROM v")
def phase_segments(spark, sf):
    return B.phase_segments(events(spark, sf), 1.0, exclusion={"MEDITATION": 15}, otherwise=5, least_seconds=100)


@query("event_checks", EVENTS + f""", e AS (SELECT session_id, phase, start_idx - CASE WHEN phase = 'MEDITATION' AND session_id % 2 = 0 THEN 40 ELSE 0 END - CASE WHEN phase = 'REST_BEFORE' THEN 3 ELSE 0 END AS a, stop_idx AS b FROM ev WHERE NOT (phase = 'REST_AFTER' AND session_id % 3 = 1)),
n AS (SELECT session_id, max(b) - 5 AS n FROM e GROUP BY 1), f AS (SELECT e.*, n, max(b) OVER w AS far, list_position([{PHASES}], phase) AS rk, max(list_position([{PHASES}], phase)) OVER w AS most FROM e JOIN n USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY a, b, phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, phase, greatest(0, least(a, n)) AS start_idx, greatest(0, least(b, n)) AS stop_idx, concat_ws(';', CASE WHEN b <= 0 OR a >= n THEN 'EVENT_OUT_OF_RANGE' END, CASE WHEN a < 0 OR b > n THEN 'EVENT_CLIPPED' END, CASE WHEN a < far THEN 'PHASE_OVERLAP' END, CASE WHEN rk < most THEN 'INVALID_EVENT_ORDER' END) AS flags, CASE WHEN b <= 0 OR a >= n THEN 'invalid' WHEN a < 0 OR b > n THEN 'clipped' ELSE 'ok' END AS status FROM f
UNION ALL SELECT session_id, p, NULL, NULL, 'MISSING_PHASE', 'invalid' FROM (SELECT session_id, unnest([{PHASES}]) AS p FROM n) WHERE (session_id, p) NOT IN (SELECT session_id, phase FROM e)""")
def event_checks(spark, sf):
    early = F.when((F.col("phase") == "MEDITATION") & (F.col("session_id") % 2 == 0), 40).otherwise(0) + F.when(F.col("phase") == "REST_BEFORE", 3).otherwise(0)
    e = events(spark, sf).withColumn("start_idx", F.col("start_idx") - early).filter(~((F.col("phase") == "REST_AFTER") & (F.col("session_id") % 3 == 1)))
    n = e.groupBy("session_id").agg((F.max("stop_idx") - 5).alias("n_samples"))
    return B.event_checks(e.join(n, "session_id"), "session_id", list(X.PHASES), n_samples=F.col("n_samples")).drop("n_samples")


@query("phase_delta_features", SQL + ", bl AS (SELECT session_id, signal, median(value) AS baseline FROM ph WHERE phase = 'REST_BEFORE' GROUP BY ALL) SELECT session_id, signal, phase, " + ", ".join(f"round({f}({x}), 5) AS {n}_{kind}" for kind, x in (("absolute", "value"), ("delta", "value - baseline")) for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + ", count(value) / count(*) AS finite_fraction FROM ph JOIN bl USING (session_id, signal) GROUP BY ALL")
def phase_delta_features(spark, sf):
    p = phases(spark, sf)
    base = p.filter("phase = 'REST_BEFORE'").groupBy(*KEYS).agg(F.median("value").alias("baseline"))
    d = B.delta_features(p, [*KEYS, "phase"], base, KEYS)
    return rounded(d, *[c for c in d.columns if c.endswith(("_absolute", "_delta"))], places=5)


@query("session_segments", EVENTS + """, w AS (SELECT session_id, start_idx AS a, stop_idx AS b, unnest(range(0, CAST(ceil((stop_idx - start_idx) / 20.0) AS BIGINT))) AS k FROM ev WHERE phase = 'MEDITATION' AND stop_idx - start_idx >= 20)
SELECT session_id, 'OVERALL' AS segment, CAST(min(start_idx) AS DOUBLE) AS start_s, CAST(max(stop_idx) AS DOUBLE) AS stop_s FROM ev GROUP BY 1 UNION ALL SELECT session_id, phase, start_idx, stop_idx FROM ev UNION ALL SELECT session_id, 'MEDITATION_WIN' || lpad(CAST(k + 1 AS VARCHAR), 2, '0'), a + k * 20.0, least(a + k * 20.0 + 20, b) FROM w""")
def session_segments(spark, sf):
    e = events(spark, sf).select("session_id", "phase", F.col("start_idx").cast("double").alias("start_s"), F.col("stop_idx").cast("double").alias("stop_s"))
    return B.session_segments(e, "session_id", seconds=20.0)


_WIDE = [f"{p}__{v}__{m}" for p in X.PHASES for v in ("even", "odd") for m in ("mean", "peak")]


@query("wide_phase_variants", SQL + " SELECT session_id, " + ", ".join(f"round({'avg' if m == 'mean' else 'max'}(value) FILTER (phase = '{p}' AND sample_idx % 2 = {0 if v == 'even' else 1}), 6) AS {p}__{v}__{m}" for p in X.PHASES for v in ("even", "odd") for m in ("mean", "peak")) + " FROM ph GROUP BY 1")
def wide_phase_variants(spark, sf):
    p = phases(spark, sf).withColumn("variant", F.when(F.col("sample_idx") % 2 == 0, "even").otherwise("odd"))
    g = p.groupBy("session_id", "phase", "variant").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return rounded(B.wide_metrics(g, ["session_id"], ["phase", "variant"], ["mean", "peak"], _WIDE), *_WIDE)


@query("window_union", SQL + ", w AS (SELECT session_id, signal, sample_idx // 10 AS window_index, sqrt(avg(value * value)) AS rms, max(value) - min(value) AS ptp, stddev_pop(value) / abs(avg(value)) * 100 AS cv FROM s GROUP BY ALL HAVING count(*) = 10) SELECT session_id, signal, window_index, round(rms, 6) AS rms, CASE WHEN signal IN ('AF3', 'AF4') THEN round(ptp, 6) END AS ptp, CASE WHEN signal LIKE 'fNIRS%' THEN round(cv, 6) END AS cv FROM w")
def window_union(spark, sf):
    s = samples(spark, sf).withColumn("window_index", F.floor(F.col("sample_idx") / 10))
    x = F.col("value")
    rms, full = F.sqrt(F.avg(x * x)).alias("rms"), F.count(F.lit(1)).alias("_n")
    kind = lambda wanted, *more: s.filter(wanted).groupBy(*KEYS, "window_index").agg(rms, *more, full).filter("_n = 10").drop("_n")
    eeg = kind(F.col("signal").isin("AF3", "AF4"), (F.max(x) - F.min(x)).alias("ptp"))
    ppg = kind(F.col("signal") == "PPG")
    fnirs = kind(F.col("signal").startswith("fNIRS"), (F.stddev_pop(x) / F.abs(F.avg(x)) * 100).alias("cv"))
    return rounded(B.union_tables([eeg, ppg, fnirs]), "rms", "ptp", "cv").select(*KEYS, "window_index", "rms", "ptp", "cv")


@query("tier_summary", MASTER + """, r AS (SELECT participant_key, o_totalprice, rank() OVER (PARTITION BY participant_key ORDER BY study_day) + (count(*) OVER (PARTITION BY participant_key, study_day) - 1) / 2 AS a, rank() OVER (PARTITION BY participant_key ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY participant_key, o_totalprice) - 1) / 2 AS b FROM m),
t2 AS (SELECT participant_key, count(*) AS n_sessions, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) + 0.0 END AS rho, median(o_totalprice) AS own FROM r GROUP BY 1),
t1 AS (SELECT participant_key, study_day, session_id, final_label FROM m QUALIFY row_number() OVER (PARTITION BY participant_key ORDER BY study_day DESC, session_id DESC) = 1)
SELECT participant_key, study_day, session_id, final_label, n_sessions, n_sessions >= 5 AS eligible, rho, CASE WHEN rho >= 0 THEN 1 ELSE -1 END AS sign, round(own - (SELECT median(own) FROM t2), 4) AS difference FROM t1 JOIN t2 USING (participant_key)""")
def tier_summary(spark, sf):
    m = master(spark, sf)
    one = T.latest(m, "participant_key", ["study_day", "session_id"], ["study_day", "session_id", "final_label"])
    two = B.eligible_trend(T.spearman(m, ["participant_key"], "study_day", "o_totalprice"), m, "participant_key").select("participant_key", "n_sessions", "eligible", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))
    own = m.groupBy("participant_key").agg(F.median("o_totalprice").alias("own"))
    three = own.crossJoin(F.broadcast(own.agg(F.median("own").alias("_p"))))  # one row on the right
    three = three.select("participant_key", F.round(F.col("own") - F.col("_p"), 4).alias("difference"))
    return B.tier_summary(one, two, three, "participant_key").withColumn("sign", B.aligned_sign(F.col("rho")))


@query("spearman_p")
def spearman_p(spark, sf):
    """Rank correlations of participants with their p values (Student's t); tests hold p against known values."""
    r = T.spearman(master(spark, sf), ["participant_key"], "study_day", "o_totalprice")
    return r.withColumn("p", B.spearman_p(F.col("rho"), F.col("n_pairs")))


@query("modality_presence", MASTER + ", a AS (SELECT participant_key, study_day, count(*) FILTER (overall_label = 'PASS') AS x, count(*) FILTER (session_role = 'primary_valid') AS y, count(*) FILTER (eeg_rms_ratio > 1) AS z FROM m GROUP BY ALL) SELECT participant_key, study_day, x AS n_eeg, y AS n_ppg, z AS n_fnirs, CAST((x > 0)::INT + (y > 0)::INT + (z > 0)::INT AS BIGINT) AS n_modalities FROM a WHERE x + y + z > 0")
def modality_presence(spark, sf):
    m = master(spark, sf)
    return B.presence({"eeg": m.filter("overall_label = 'PASS'"), "ppg": m.filter("session_role = 'primary_valid'"), "fnirs": m.filter("eeg_rms_ratio > 1")}, ["participant_key", "study_day"])


@query("session_timeseries_json")
def session_timeseries_json(spark, sf):
    return B.nested_series(samples(spark, sf), ["session_id"], "signal", 60)


@query("qc_kurtosis_window", SQL + ", w AS (SELECT session_id, signal, CAST(sample_idx // 10 AS BIGINT) AS window_index, kurtosis(value) + 3 AS k, count(*) AS n FROM s GROUP BY ALL) SELECT session_id, signal, window_index, round(k, 5) AS kurtosis FROM w WHERE n = 10")
def qc_kurtosis_window(spark, sf):
    return rounded(S.window_table(samples(spark, sf), 10).select(*KEYS, "window_index", "kurtosis"), "kurtosis", places=5)


@query("qc_dynamic_ratio", SQL + ", w AS (SELECT session_id, signal, sample_idx // 10 AS window_index, sqrt(avg(value * value)) AS rms FROM s GROUP BY ALL HAVING count(*) = 10) SELECT session_id, signal, round(quantile_cont(rms, 0.95) / greatest(median(rms), 2.0), 6) AS dynamic_ratio FROM w GROUP BY ALL")
def qc_dynamic_ratio(spark, sf):
    w = S.window_table(samples(spark, sf), 10)
    return rounded(w.groupBy(*KEYS).agg(S.dynamic_ratio("rms", 0.95, 2.0).alias("dynamic_ratio")), "dynamic_ratio")


@query("trimmed_mean", "WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, round(avg(x) FILTER (k > floor(n * 0.1) AND k <= n - floor(n * 0.1)), 4) AS trimmed_mean, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM r GROUP BY 1")
def trimmed_mean(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey"), F.col("l_extendedprice").alias("value"), F.monotonically_increasing_id().alias("sample_idx"))
    f = X.phase_features(s, ["l_suppkey"], 1.0)
    return f.select("l_suppkey", F.round("trimmed10", 4).alias("trimmed_mean"), F.round("iqr", 4).alias("iqr"))
