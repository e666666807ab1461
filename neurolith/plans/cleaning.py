"""Queries of the EEG cleaning steps over the sample stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurolith.operators import cleaning as C
from neurolith.operators import spectra as P
from neurolith.plans.fixtures import SQL, samples
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

KEYS = ["session_id", "signal"]


def _without(table: str, f: float, fs: float, size: int, out: str) -> str:
    a = f"2 * pi() * {f} / {fs} * sample_idx"
    return f"""{out}a AS (SELECT *, cos({a}) AS c, sin({a}) AS sn FROM {table}), {out}b AS (SELECT *, sum(c * c) OVER w AS cc, sum(sn * sn) OVER w AS ss, sum(c * sn) OVER w AS cs, sum(x * c) OVER w AS xc, sum(x * sn) OVER w AS xs FROM {out}a WINDOW w AS (PARTITION BY session_id, signal, sample_idx // {size})),
{out} AS (SELECT session_id, signal, sample_idx, CASE WHEN cc * ss - cs * cs > 1e-9 THEN x - ((xc * ss - xs * cs) * c + (xs * cc - xc * cs) * sn) / (cc * ss - cs * cs) ELSE x END AS x FROM {out}b)"""


@query("sine_regression", SQL + ", l0 AS (SELECT session_id, signal, sample_idx, value AS x FROM s), " + _without("l0", 50.0, 244.0, 61, "l1") + ", " + _without("l1", 100.0, 244.0, 61, "l2") + " SELECT session_id, signal, sample_idx, round(x, 5) AS cleaned FROM l2")
def sine_regression(spark, sf):
    d = C.remove_line(samples(spark, sf).select(*KEYS, "sample_idx", "value"), KEYS, fs=244.0, freqs=[50.0, 100.0], seconds=0.25)
    return rounded(d.select(*KEYS, "sample_idx", "cleaned"), "cleaned", places=5)


EVENTS = ", tg AS (SELECT session_id, sample_idx + 3 AS onset, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS tag FROM s WHERE signal = 'PPG' AND event_id % 9 = 0 AND session_id <> 2)"


def tags(spark, sf):
    s = samples(spark, sf).filter((F.col("signal") == "PPG") & (F.col("event_id") % 9 == 0) & (F.col("session_id") != 2))
    return s.select("session_id", F.col("sample_idx").alias("onset"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("tag"))


def _epochs(spark, sf):
    return C.event_epochs(samples(spark, sf), tags(spark, sf), KEYS, before=2, after=5, offset=3)


EPOCHS = SQL + EVENTS + ", ep AS (SELECT s.session_id, s.signal, tag, onset, count(*) AS n, avg(value) AS mean, max(value) AS peak, min(CASE WHEN sample_idx = onset - 2 THEN value END) AS first FROM s JOIN tg ON s.session_id = tg.session_id AND sample_idx BETWEEN onset - 2 AND onset + 5 GROUP BY ALL HAVING count(*) = 8)"


@query("event_epochs", EPOCHS + " SELECT session_id, signal, tag, onset, round(mean, 6) AS mean, round(peak, 6) AS peak, round(first, 6) AS first FROM ep")
def event_epochs(spark, sf):
    e = _epochs(spark, sf)
    d = e.select(*KEYS, "tag", "onset", (F.aggregate("epoch", F.lit(0.0), lambda a, x: a + x) / F.size("epoch")).alias("mean"), F.array_max("epoch").alias("peak"), F.get("epoch", F.lit(0)).alias("first"))
    return rounded(d, "mean", "peak", "first")


@query("condition_counts", EPOCHS + " SELECT condition, signal, count(*) AS n_epochs, round(avg(peak), 6) AS peak FROM ep JOIN (VALUES ('all', 'a'), ('all', 'b'), ('odd', 'b')) c(condition, t) ON tag = t GROUP BY ALL")
def condition_counts(spark, sf):
    d = C.by_condition(_epochs(spark, sf), {"all": ["a", "b"], "odd": ["b"], "none": ["c"]})
    return rounded(d.groupBy("condition", "signal").agg(F.count(F.lit(1)).alias("n_epochs"), F.avg(F.array_max("epoch")).alias("peak")), "peak")


@query("untagged_recordings", SQL + EVENTS + " SELECT DISTINCT session_id, 'NoTags' AS error_type, 'no event of the wanted kinds' AS message FROM s WHERE session_id NOT IN (SELECT session_id FROM tg)")
def untagged_recordings(spark, sf):
    return C.untagged(samples(spark, sf), tags(spark, sf), "session_id")


@query("fixed_epochs", SQL + ", e AS (SELECT session_id, signal, CAST(sample_idx // 20 AS BIGINT) AS segment, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM s GROUP BY ALL) SELECT session_id, signal, segment, round(mean, 6) AS mean, round(var, 4) AS var FROM e WHERE n = 20")
def fixed_epochs(spark, sf):
    s = P.segments(samples(spark, sf), KEYS, ["value"], 20, 20)
    mean = F.aggregate("value", F.lit(0.0), lambda a, x: a + x) / F.size("value")
    d = s.withColumn("mean", mean).withColumn("var", F.aggregate(F.transform("value", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x) / F.size("value"))
    return rounded(rounded(d.select(*KEYS, "segment", "mean", "var"), "mean"), "var", places=4)


@query("reference_back", SQL + ", r AS (SELECT session_id, signal, sample_idx, value FROM s WHERE signal IN ('AF3', 'AF4') UNION ALL SELECT DISTINCT session_id, 'CPz', sample_idx, 0.0 FROM s WHERE signal IN ('AF3', 'AF4')) SELECT session_id, signal, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY ALL")
def reference_back(spark, sf):
    s = C.kept_channels(samples(spark, sf), "signal", include=["AF3", "AF4", "PPG"], exclude=["PPG"])
    return rounded(C.with_reference(s, KEYS, "signal", "CPz").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@query("bayes_shrink_blocks", SQL + """, h AS (SELECT session_id, signal, sample_idx // 2 AS k, (max(CASE WHEN sample_idx % 2 = 0 THEN value END) - max(CASE WHEN sample_idx % 2 = 1 THEN value END)) / sqrt(2) AS d FROM s GROUP BY ALL HAVING count(*) = 2),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, signal) AS n FROM h), p AS (SELECT *, CAST(greatest(1, round_even(n / 40.0::DOUBLE, 0)) AS BIGINT) AS parts FROM n),
b AS (SELECT *, CASE WHEN k < n % parts * (n // parts + 1) THEN k // (n // parts + 1) ELSE n % parts + (k - n % parts * (n // parts + 1)) // (n // parts) END AS block FROM p),
t AS (SELECT session_id, signal, block, (median(abs(d)) / 0.6745) ** 2 / sqrt(greatest(avg(d * d) - (median(abs(d)) / 0.6745) ** 2, 1e-12)) AS t FROM b GROUP BY ALL)
SELECT b.session_id, b.signal, k, CAST(b.block AS BIGINT) AS block, round(sign(d) * greatest(abs(d) - t, 0), 5) + 0.0 AS shrunk FROM b JOIN t ON b.session_id = t.session_id AND b.signal = t.signal AND b.block = t.block""")
def bayes_shrink_blocks(spark, sf):
    at = lambda odd: F.max(F.when(F.col("sample_idx") % 2 == odd, F.col("value")))
    h = samples(spark, sf).groupBy(*KEYS, F.floor(F.col("sample_idx") / 2).alias("k")).agg(((at(0) - at(1)) / F.sqrt(F.lit(2.0))).alias("d"), F.count(F.lit(1)).alias("_n")).filter("_n = 2")
    h = h.withColumn("block", C.block_of(F.col("k"), F.count(F.lit(1)).over(Window.partitionBy(*KEYS)), 40))
    d = C.bayes_threshold(h, [*KEYS, "block"], "d").select(*KEYS, "k", "block", "shrunk")
    return rounded(d, "shrunk", places=5).withColumn("shrunk", F.col("shrunk") + F.lit(0.0))


@query("recording_quality", SQL + ", c AS (SELECT session_id, signal, stddev_pop(value) < 50 AS bad FROM s GROUP BY ALL), e AS (SELECT session_id, sample_idx // 50 AS epoch, max(value) > 400 AS rejected FROM s GROUP BY ALL), a AS (SELECT session_id, count(*) AS n_channels, count(*) FILTER (NOT bad) AS n_good FROM c GROUP BY 1), b AS (SELECT session_id, count(*) AS n_epochs, count(*) FILTER (NOT rejected) AS n_kept FROM e GROUP BY 1) SELECT session_id, n_channels, n_good, n_epochs, n_kept, round(n_good * 100.0::DOUBLE / n_channels, 6) AS percent_good, round(n_kept * 100.0::DOUBLE / n_epochs, 6) AS percent_kept FROM a JOIN b USING (session_id)")
def recording_quality(spark, sf):
    s = samples(spark, sf)
    channels = s.groupBy(*KEYS).agg((F.stddev_pop("value") < 50).alias("bad"))
    epochs = s.groupBy("session_id", F.floor(F.col("sample_idx") / 50).alias("epoch")).agg((F.max("value") > 400).alias("rejected"))
    return rounded(C.quality_row(s, channels, epochs, "session_id"), "percent_good", "percent_kept")
