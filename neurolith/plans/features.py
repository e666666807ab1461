"""Feature queries: optical, phases, intervals and epochs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import kernels as K
from neurolith.plans.fixtures import SQL, phases, samples, table
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

(_A, _B), (_C, _D) = X.EXTINCTION
_DET = _A * _D - _B * _C
_P740, _P850 = X.DISTANCE_CM * X.path_factor(740.0), X.DISTANCE_CM * X.path_factor(850.0)


def _mbll(ref: str) -> str:
    return f"""WITH r AS (SELECT *, avg({ref.format('l_extendedprice')}) OVER (PARTITION BY l_orderkey) AS r1, avg({ref.format('l_quantity')}) OVER (PARTITION BY l_orderkey) AS r2 FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n FROM lineitem)),
o AS (SELECT *, -log10(greatest(l_extendedprice, 1e-6) / greatest(r1, 1e-6)) / {_P740!r} AS x, -log10(greatest(l_quantity, 1e-6) / greatest(r2, 1e-6)) / {_P850!r} AS y FROM r),
h AS (SELECT *, ({_D / _DET!r} * x - {_B / _DET!r} * y) * 1000 AS hbo, ({_A / _DET!r} * y - {_C / _DET!r} * x) * 1000 AS hbr FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, round(hbo, 6) AS hbo, round(hbr, 6) AS hbr, round(hbo + hbr, 6) AS hbt FROM h"""


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def _hb(spark, sf, n):
    d = X.haemoglobin(table(spark, sf, "lineitem"), ["l_orderkey"], ORDER, "l_extendedprice", "l_quantity", n)
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", "hbo", "hbr", "hbt"), "hbo", "hbr", "hbt")


@query("mbll", _mbll("{}"))
def mbll(spark, sf):
    return _hb(spark, sf, None)


@query("mbll_baseline", _mbll("CASE WHEN n <= 2 THEN {} END"))
def mbll_baseline(spark, sf):
    return _hb(spark, sf, 2)


@query("od_from_intensity", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0 - log10(greatest(l_extendedprice, 1e-6) / greatest(avg(l_extendedprice) OVER (PARTITION BY l_orderkey), 1e-6)), 8) AS od FROM lineitem")
def od_from_intensity(spark, sf):
    from pyspark.sql import Window

    od = X.optical_density(F.col("l_extendedprice"), F.avg("l_extendedprice").over(Window.partitionBy("l_orderkey")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(od, 8).alias("od"))


KEYS = ["session_id", "signal", "phase"]
FEATURES = SQL + """,
q AS (SELECT *, median(value) OVER k AS m, count(*) OVER k AS n, row_number() OVER (PARTITION BY session_id, signal, phase ORDER BY value, sample_idx) AS r, lag(value) OVER (PARTITION BY session_id, signal, phase ORDER BY sample_idx) AS prev FROM ph WINDOW k AS (PARTITION BY session_id, signal, phase)),
pf AS (SELECT session_id, signal, phase, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd, 1.4826 * median(abs(value - m)) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, max(value) - min(value) AS ptp,
  avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN value END) AS trimmed10, regr_slope(value, sample_idx / 6000.0::DOUBLE) AS slope_per_min, sum((value + prev) / 2) / 100 AS auc, count(value) / 100.0::DOUBLE AS valid_seconds FROM q GROUP BY ALL)"""
METRICS = ["mean", "median", "sd", "mad", "iqr", "ptp", "trimmed10", "slope_per_min", "auc", "valid_seconds"]


@query("phase_features", FEATURES + "SELECT session_id, signal, phase, " + ", ".join(f'round({m}, {6 if m in ("auc", "trimmed10") else 4}) AS "{m}"' for m in METRICS) + " FROM pf")
def phase_features(spark, sf):
    f = X.phase_features(phases(spark, sf), KEYS, 100.0).select(*KEYS, *METRICS)
    return rounded(f, *[m for m in METRICS if m not in ("auc", "trimmed10")], places=4).withColumns({m: F.round(m, 6) for m in ("auc", "trimmed10")})


@query("phase_changes", FEATURES + """,
l AS (SELECT session_id, signal, phase, 'mean' AS metric, mean AS v FROM pf UNION ALL SELECT session_id, signal, phase, 'median', median FROM pf UNION ALL SELECT session_id, signal, phase, 'iqr', iqr FROM pf),
p AS (SELECT * FROM (VALUES ('REST_BEFORE', 'MEDITATION'), ('MEDITATION', 'REST_AFTER'), ('REST_BEFORE', 'REST_AFTER')) t(phase_from, phase_to))
SELECT a.session_id, a.signal, a.metric, phase_from, phase_to, round(a.v, 5) AS value_from, round(b.v, 5) AS value_to, round(b.v - a.v, 5) AS change FROM p JOIN l a ON a.phase = phase_from JOIN l b ON b.phase = phase_to AND a.session_id = b.session_id AND a.signal = b.signal AND a.metric = b.metric""")
def phase_changes(spark, sf):
    f = X.phase_features(phases(spark, sf), KEYS, 100.0)
    d = X.phase_changes(f, ["session_id", "signal"], ["mean", "median", "iqr"], [("REST_BEFORE", "MEDITATION"), ("MEDITATION", "REST_AFTER"), ("REST_BEFORE", "REST_AFTER")])
    return rounded(d, "value_from", "value_to", "change", places=5)


@query("wide_by_phase", SQL + "SELECT session_id, signal, round(avg(CASE WHEN phase = 'REST_BEFORE' THEN value END), 6) AS value__REST_BEFORE, round(avg(CASE WHEN phase = 'MEDITATION' THEN value END), 6) AS value__MEDITATION, round(avg(CASE WHEN phase = 'REST_AFTER' THEN value END), 6) AS value__REST_AFTER FROM ph GROUP BY ALL")
def wide_by_phase(spark, sf):
    d = phases(spark, sf).groupBy("session_id", "signal").pivot("phase", list(X.PHASES)).agg(F.avg("value"))
    return d.select("session_id", "signal", *[F.round(p, 6).alias(f"value__{p}") for p in X.PHASES])


@query("unpivot_phases", SQL + "SELECT session_id, signal, phase, round(avg(value), 6) AS value FROM ph GROUP BY ALL")
def unpivot_phases(spark, sf):
    wide = phases(spark, sf).groupBy("session_id", "signal").pivot("phase", list(X.PHASES)).agg(F.avg("value"))
    return rounded(wide.unpivot(["session_id", "signal"], list(X.PHASES), "phase", "value").filter("value IS NOT NULL"), "value")


@query("session_phase_median", SQL + "SELECT session_id, signal, phase, round(median(value), 6) AS value, count(*) AS n_epochs FROM ph GROUP BY ALL")
def session_phase_median(spark, sf):
    return rounded(phases(spark, sf).groupBy(*KEYS).agg(F.median("value").alias("value"), F.count(F.lit(1)).alias("n_epochs")), "value")


@query("phase_thirds", SQL + ", g AS (SELECT session_id, signal, min(sample_idx) AS a, max(sample_idx) + 1 AS b FROM ph WHERE phase = 'MEDITATION' GROUP BY ALL) SELECT session_id, signal, CAST(k AS INT) AS part, CAST(a + round_even((b - a) * k / 3.0::DOUBLE, 0) AS BIGINT) AS part_start, CAST(a + round_even((b - a) * (k + 1) / 3.0::DOUBLE, 0) AS BIGINT) AS part_stop FROM g, range(3) t(k)")
def phase_thirds(spark, sf):
    g = phases(spark, sf).filter("phase = 'MEDITATION'").groupBy("session_id", "signal").agg(F.min("sample_idx").alias("a"), (F.max("sample_idx") + 1).alias("b"))
    return X.thirds(g, "a", "b").select("session_id", "signal", "part", "part_start", "part_stop")


@query("robust_outlier_flags", """WITH a AS (SELECT *, median(l_extendedprice) OVER k AS m1, median(l_quantity) OVER k AS m2 FROM lineitem WINDOW k AS (PARTITION BY l_returnflag, l_linestatus)),
b AS (SELECT *, abs(0.67448975 * (l_extendedprice - m1) / median(abs(l_extendedprice - m1)) OVER k) AS z1, abs(0.67448975 * (l_quantity - m2) / median(abs(l_quantity - m2)) OVER k) AS z2 FROM a WINDOW k AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(z1, z2), 6) AS max_abs_robust_z, greatest(z1, z2) > 1.5 AS robust_outlier FROM b""")
def robust_outlier_flags(spark, sf):
    d = X.outlier_flags(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], 1.5)
    return rounded(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "max_abs_robust_z", "robust_outlier"), "max_abs_robust_z")


_FLAGS = "concat_ws(';', CASE WHEN value > 150 THEN 'SATURATION' END, CASE WHEN event_id % 11 = 0 THEN 'STATISTICAL_OUTLIER' END, CASE WHEN event_id % 13 = 0 THEN 'BASELINE_HIGH_VARIABILITY' END)"


@query("qc_flag_rollup", f"WITH f AS (SELECT event_id, list_sort(list_distinct(list_filter(string_split({_FLAGS}, ';'), lambda x: x <> ''))) AS l FROM events) SELECT event_id, array_to_string(l, ';') AS flags, CAST(len(l) AS INT) AS n_flags, len(list_filter(l, lambda x: x <> 'STATISTICAL_OUTLIER')) = 0 AS qc_pass FROM f")
def qc_flag_rollup(spark, sf):
    return X.roll_up_flags(table(spark, sf, "events").select("event_id", F.expr(_FLAGS.replace("';'", "';'")).alias("flags")), "flags")


@query("flag_counts", f"WITH f AS (SELECT unnest(string_split({_FLAGS}, ';')) AS flag FROM events) SELECT flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY 1")
def flag_counts(spark, sf):
    return qc_flag_rollup(spark, sf).select(F.explode(F.split("flags", ";")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


IBI = "WITH b AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) * {scale} AS ibi FROM b), i AS (SELECT *, (ibi - lag(ibi) OVER (PARTITION BY user_id ORDER BY t)) * 1000 AS d FROM g WHERE ibi BETWEEN {lo} AND {hi})"


def beats(spark, sf):
    return table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("ibi_time_domain", IBI.format(scale="(1 / 30000.0::DOUBLE)", lo=0.3, hi=1.8) + """, a AS (SELECT user_id, count(*) AS n_ibi, CASE WHEN count(*) > 1 THEN 60 / avg(ibi) END AS hr_bpm, sqrt(avg(d * d)) AS rmssd_ms, stddev_samp(ibi) * 1000 AS sdrr_ms, avg(CASE WHEN abs(d) > 50 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) * 100 AS prr50, avg(CASE WHEN abs(d) > 20 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) * 100 AS prr20, sum(ibi) AS seconds FROM i GROUP BY 1)
SELECT user_id, n_ibi, round(hr_bpm, 4) AS hr_bpm, round(rmssd_ms, 4) AS rmssd_ms, round(sdrr_ms, 4) AS sdrr_ms, round(prr50, 4) AS prr50, round(prr20, 4) AS prr20, CASE WHEN hr_bpm IS NULL THEN 'NO_VALID_IBI' WHEN seconds < 30 THEN 'SHORT_SEGMENT' WHEN n_ibi < 10 THEN 'LOW_BEAT_COUNT' ELSE 'OK' END AS quality_flag FROM a""")
def ibi_time_domain(spark, sf):
    d = X.hrv(X.intervals(beats(spark, sf), "user_id", "t", 1 / 30000.0, 0.3, 1.8), "user_id", "t")
    return rounded(d.drop("seconds"), "hr_bpm", "rmssd_ms", "sdrr_ms", "prr50", "prr20", places=4)


@query("bbi_resp_rate", IBI.format(scale="(1 / 5000.0::DOUBLE)", lo=2, hi=10) + ", a AS (SELECT user_id, count(*) AS n_bbi, 60 / avg(ibi) AS resp_rate, stddev_samp(ibi) / avg(ibi) * 100 AS resp_cv, sum(ibi) AS seconds FROM i GROUP BY 1) SELECT user_id, n_bbi, round(resp_rate, 4) AS resp_rate, round(resp_cv, 4) AS resp_cv, CASE WHEN resp_rate IS NULL THEN 'NO_VALID_BREATHS' WHEN seconds < 30 THEN 'SHORT_SEGMENT' WHEN n_bbi < 3 THEN 'LOW_BREATH_COUNT' ELSE 'OK' END AS quality_flag FROM a")
def bbi_resp_rate(spark, sf):
    d = X.breathing(X.intervals(beats(spark, sf), "user_id", "t", 1 / 5000.0, 2, 10), "user_id")
    return rounded(d.drop("seconds"), "resp_rate", "resp_cv", places=4)


@query("phase_windows", SQL + ", g AS (SELECT session_id, signal, phase, min(sample_idx) * 1.0::DOUBLE AS a, (max(sample_idx) + 1) * 1.0::DOUBLE AS b FROM ph GROUP BY ALL) SELECT session_id, signal, phase, w AS \"window\", a + w * 30 AS from_s, least(a + w * 30 + 30, b) AS to_s FROM (SELECT *, unnest(range(CAST(ceil((b - a) / 30) AS BIGINT))) AS w FROM g WHERE b - a >= 30)")
def phase_windows(spark, sf):
    g = phases(spark, sf).groupBy(*KEYS).agg(F.min("sample_idx").cast("double").alias("start_s"), (F.max("sample_idx") + 1).cast("double").alias("stop_s"))
    return X.anchored_windows(g, 30.0).select(*KEYS, "window", "from_s", "to_s")


@query("sliding_windows", SQL + ", e AS (SELECT session_id, signal, value, unnest(range(greatest(0, CAST(floor((sample_idx - 40) / 10.0) AS BIGINT) + 1), CAST(floor(sample_idx / 10.0) AS BIGINT) + 1)) AS win FROM s) SELECT session_id, signal, win AS \"window\", count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL HAVING count(*) = 40")
def sliding_windows(spark, sf):
    return rounded(X.sliding_windows(samples(spark, sf), ["session_id", "signal"], 40, 10), "mean")


@query("epoch_phase_label", SQL + """, e AS (SELECT session_id, CAST(k AS BIGINT) AS epoch_idx, k * 10.0::DOUBLE AS start, k * 10.0::DOUBLE + 10 AS stop FROM (SELECT DISTINCT session_id FROM s), range(12) t(k)),
a AS (SELECT session_id, k * 17.0::DOUBLE AS onset, CASE WHEN k % 4 = 3 THEN 0.0::DOUBLE ELSE 11.0::DOUBLE + session_id END AS duration, 'P' || k AS description FROM (SELECT DISTINCT session_id FROM s), range(6) t(k)),
j AS (SELECT e.*, description, row_number() OVER (PARTITION BY e.session_id, epoch_idx ORDER BY least(onset + duration, stop) - greatest(onset, start) DESC, onset) AS n FROM e LEFT JOIN a ON e.session_id = a.session_id AND duration > 0 AND onset < stop AND onset + duration > start)
SELECT session_id, epoch_idx, start, stop, coalesce(description, 'UNLABELED') AS phase FROM j WHERE n = 1""")
def epoch_phase_label(spark, sf):
    s = samples(spark, sf).select("session_id").distinct()
    e = s.withColumn("epoch_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("start", F.col("epoch_idx") * F.lit(10.0)).withColumn("stop", F.col("start") + 10)
    a = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("session_id", (F.col("k") * F.lit(17.0)).alias("onset"), F.when(F.col("k") % 4 == 3, 0.0).otherwise(F.lit(11.0) + F.col("session_id")).alias("duration"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("description"))
    return X.label_epochs(e, a, ["session_id"])


EPOCHS = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"


def epochs(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


@query("hjorth", EPOCHS + """, d AS (SELECT *, [a[i + 1] - a[i] for i in range(1, len(a))] AS b FROM e), f AS (SELECT *, [b[i + 1] - b[i] for i in range(1, len(b))] AS c FROM d),
v AS (SELECT vec_id, list_var_pop(a) AS v0, list_var_pop(b) AS v1, list_var_pop(c) AS v2 FROM f) SELECT vec_id, round(v0, 8) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM v""")
def hjorth(spark, sf):
    d = epochs(spark, sf).withColumns(X.hjorth(F.col("a"))).select("vec_id", F.round("activity", 8).alias("activity"), "mobility", "complexity")
    return rounded(d, "mobility", "complexity")


def _dft(k: int) -> str:
    parts = [f"list_sum([a[i + 1] * {f}(2 * pi() * {k} * i / 64) for i in range(64)])" for f in ("cos", "sin")]
    return f"(({parts[0]}) ** 2 + ({parts[1]}) ** 2) / 64"


_POWERS = EPOCHS + ", p AS (SELECT vec_id, label, " + ", ".join(f"{' + '.join(_dft(k) for k in range(lo, hi + 1))} AS {name}" for name, (lo, hi) in X.BANDS.items()) + " FROM e)"


@query("band_power_dft", _POWERS + "SELECT vec_id, " + ", ".join(f"round({b}, 6) AS {b}" for b in X.BANDS) + ", round(alpha / (delta + theta + alpha + beta), 6) AS alpha_rel, round(theta / alpha, 4) AS theta_alpha FROM p")
def band_power_dft(spark, sf):
    p = epochs(spark, sf).withColumns(X.band_powers(F.col("a"), 64))
    total = sum((F.col(b) for b in X.BANDS), F.lit(0.0))
    return p.select("vec_id", *[F.round(b, 6).alias(b) for b in X.BANDS], F.round(F.col("alpha") / total, 6).alias("alpha_rel"), F.round(F.col("theta") / F.col("alpha"), 4).alias("theta_alpha"))


@query("faa_fei", _POWERS + "SELECT vec_id // 2 AS pair, round(ln(max(CASE WHEN vec_id % 2 = 1 THEN alpha END)) - ln(max(CASE WHEN vec_id % 2 = 0 THEN alpha END)), 5) AS faa, round(sum(beta) / (sum(alpha) + sum(theta)), 5) AS fei FROM p GROUP BY 1 HAVING count(*) = 2")
def faa_fei(spark, sf):
    p = epochs(spark, sf).withColumns(X.band_powers(F.col("a"), 64))
    alpha = lambda side: F.log(F.max(F.when(F.col("vec_id") % 2 == side, F.col("alpha"))))
    g = p.groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.round(alpha(1) - alpha(0), 5).alias("faa"), F.round(F.sum("beta") / (F.sum("alpha") + F.sum("theta")), 5).alias("fei"), F.count(F.lit(1)).alias("_n"))
    return g.filter("_n = 2").drop("_n")


@query("shannon_hist", EPOCHS + ", x AS (SELECT vec_id, list_min(a) AS lo, list_max(a) AS hi, unnest(a) AS x FROM e), n AS (SELECT vec_id, least(floor((x - lo) / (hi - lo) * 64), 63) AS b, count(*) AS n FROM x GROUP BY ALL) SELECT vec_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1")
def shannon_hist(spark, sf):
    return rounded(X.shannon_histogram(epochs(spark, sf), "vec_id", "a"), "entropy")


@query("epoch_reject_amplitude", EPOCHS + "SELECT vec_id, round(list_max([abs(x) for x in a]), 8) AS max_abs, list_max([abs(x) for x in a]) > 0.35 AS rejected FROM e")
def epoch_reject_amplitude(spark, sf):
    top = F.array_max(F.transform("a", lambda x: F.abs(x)))
    return epochs(spark, sf).select("vec_id", F.round(top, 8).alias("max_abs"), (top > 0.35).alias("rejected"))


@query("average_reference", EPOCHS + ", x AS (SELECT vec_id, label, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM e) SELECT vec_id, CAST(i AS INT) AS i, round(x - avg(x) OVER (PARTITION BY label, i), 8) AS value FROM x")
def average_reference(spark, sf):
    x = epochs(spark, sf).select("vec_id", "label", F.posexplode("a").alias("i", "x"))
    mean = x.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return x.join(mean, ["label", "i"]).select("vec_id", "i", F.round(F.col("x") - F.col("m"), 8).alias("value"))


@query("baseline_correct", EPOCHS + "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(a[i] - list_avg(a[1:16]), 8) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM e)")
def baseline_correct(spark, sf):
    d = epochs(spark, sf).withColumn("_m", X._mean(F.slice("a", 1, 16)))
    return d.select("vec_id", "_m", F.posexplode("a").alias("i", "x")).select("vec_id", "i", F.round(F.col("x") - F.col("_m"), 8).alias("value"))


@query("haar_shrink", EPOCHS + """, d AS (SELECT vec_id, [(a[2 * i + 2] - a[2 * i + 1]) / sqrt(2) for i in range(32)] AS d FROM e), s AS (SELECT *, list_median([abs(x) for x in d]) / 0.6745 AS sg, list_avg([x * x for x in d]) AS e2 FROM d), t AS (SELECT *, sg * sg / sqrt(greatest(e2 - sg * sg, 1e-12)) AS t FROM s)
SELECT vec_id, round(sg, 8) AS sigma, round(t, 6) AS threshold, round(list_sum([greatest(abs(x) - t, 0) for x in d]), 6) AS kept FROM t""")
def haar_shrink(spark, sf):
    detail = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.get("a", 2 * i + 1) - F.get("a", 2 * i)) / F.lit(math.sqrt(2)))
    d = epochs(spark, sf).withColumn("d", detail)
    ranked = F.array_sort(F.transform("d", lambda x: F.abs(x)))
    d = d.withColumn("sigma", (F.get(ranked, F.lit(15)) + F.get(ranked, F.lit(16))) / 2 / 0.6745).withColumn("_e", X._mean(F.transform("d", lambda x: x * x)))
    d = d.withColumn("threshold", F.col("sigma") * F.col("sigma") / F.sqrt(F.greatest(F.col("_e") - F.col("sigma") * F.col("sigma"), F.lit(1e-12))))
    kept = X._sum(F.transform("d", lambda x: F.greatest(F.abs(x) - F.col("threshold"), F.lit(0.0))))
    d = d.withColumn("kept", kept)
    return d.select("vec_id", F.round("sigma", 8).alias("sigma"), F.round("threshold", 6).alias("threshold"), F.round("kept", 6).alias("kept"))


@query("phase_baseline", SQL + """, b AS (SELECT *, count(*) OVER (PARTITION BY session_id, signal) - row_number() OVER (PARTITION BY session_id, signal ORDER BY sample_idx) AS ahead, count(*) OVER (PARTITION BY session_id, signal) AS n FROM ph WHERE phase = 'REST_BEFORE'),
m AS (SELECT *, median(value) OVER (PARTITION BY session_id, signal) AS md FROM s), a AS (SELECT session_id, signal, 1.4826 * median(abs(value - md)) AS mad FROM m GROUP BY ALL),
g AS (SELECT session_id, signal, median(value) AS baseline, stddev_pop(value) AS sd, max(n) AS n FROM b WHERE ahead < 10 GROUP BY ALL)
SELECT session_id, signal, round(baseline, 6) AS baseline, sd > 1.2 * mad AS baseline_high_variability FROM g JOIN a USING (session_id, signal) WHERE n >= 5""")
def phase_baseline(spark, sf):
    return rounded(X.phase_baseline(phases(spark, sf), "REST_BEFORE", last=10, least=5, most_ratio=1.2), "baseline")


@query("event_align", """WITH e AS (SELECT o_custkey AS session_id, o_orderkey AS event_order, CAST(o_orderkey % 1300 AS BIGINT) - 100 AS a, CAST(o_orderkey % 1300 AS BIGINT) - 100 + 150 AS b, CAST(o_orderkey % 3 AS INT) AS phase_rank FROM orders),
f AS (SELECT *, least(greatest(a, 0), 1000) AS start_idx, least(greatest(b, 0), 1000) AS stop_idx, lag(b) OVER w AS p, lag(phase_rank) OVER w AS r FROM e WINDOW w AS (PARTITION BY session_id ORDER BY event_order))
SELECT session_id, event_order, start_idx, stop_idx, concat_ws(';', CASE WHEN a < 0 OR b > 1000 THEN 'EVENT_CLIPPED' END, CASE WHEN b <= 0 OR a >= 1000 THEN 'EVENT_OUT_OF_RANGE' END, CASE WHEN a < p THEN 'EVENT_OVERLAP' END, CASE WHEN phase_rank < r THEN 'EVENT_ORDER' END) AS flags FROM f""")
def event_align(spark, sf):
    o = table(spark, sf, "orders")
    a = (F.col("o_orderkey") % 1300).cast("long") - 100
    e = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("event_order"), a.alias("start_idx"), (a + 150).alias("stop_idx"), (F.col("o_orderkey") % 3).cast("int").alias("phase_rank"))
    return X.align_events(e, 1000).drop("phase_rank")


@query("phase_coverage", SQL + "SELECT session_id, signal, CAST(count(DISTINCT phase) AS INT) AS n_phases, count(DISTINCT phase) = 3 AS complete FROM ph WHERE value > 20 GROUP BY ALL")
def phase_coverage(spark, sf):
    wide = phases(spark, sf).filter("value > 20").groupBy("session_id", "signal").pivot("phase", list(X.PHASES)).agg(F.count("value"))
    n = F.size(F.array_compact(F.array(*[F.col(p) for p in X.PHASES])))
    return wide.select("session_id", "signal", n.alias("n_phases"), (n == 3).alias("complete"))


@query("hrv_frequency")
def hrv_frequency(spark, sf):
    i = X.intervals(beats(spark, sf), "user_id", "t", 1 / 30000.0, 0.3, 1.8).withColumn("t", F.col("t") / 30000.0)
    return K.tachogram_power(i, "user_id", "t")
