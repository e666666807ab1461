"""Queries of the cleaning steps that need more than one window: heart beats, smooth thresholds, filters and rates by blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import blocks as B
from neurolith.operators import cleaning as C
from neurolith.operators import heartbeats as H
from neurolith.operators import line_noise as L
from neurolith.plans.fixtures import SQL, samples
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

KEYS = ["session_id", "signal"]

# Places of beats: about every 17th sample, with a jitter of up to 4, away from the ends of epochs of 100 samples.
PEAKS = SQL + """, pk AS (SELECT DISTINCT session_id, CAST(sample_idx // 100 AS BIGINT) AS epoch, CAST((sample_idx // 17) * 17 + (sample_idx // 17) % 5 AS BIGINT) AS peak FROM s),
p AS (SELECT session_id, peak // 100 AS epoch, peak FROM pk WHERE epoch = peak // 100 AND peak % 100 BETWEEN 8 AND 91)"""


def beats(spark, sf):
    s = samples(spark, sf)
    part = F.floor(F.col("sample_idx") / 17)
    p = s.select("session_id", F.floor(F.col("sample_idx") / 100).alias("epoch"), (part * 17 + part % 5).alias("peak")).distinct()
    return p.filter((F.col("epoch") == F.floor(F.col("peak") / 100)) & (F.col("peak") % 100).between(8, 91))


@query("beats_removed", PEAKS + """,
n AS (SELECT s.session_id, s.signal, p.epoch, p.peak, s.sample_idx - p.peak AS lag, s.value, count(*) OVER (PARTITION BY s.session_id, s.signal, p.peak) AS n FROM s JOIN p ON s.session_id = p.session_id AND s.sample_idx BETWEEN p.peak - 8 AND p.peak + 7),
w AS (SELECT * FROM n WHERE n = 16), t AS (SELECT session_id, signal, epoch, lag, avg(value) AS t FROM w GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT session_id, signal, epoch, peak, sum(value * t) AS xt, sum(t * t) + 1e-20 AS tt FROM w JOIN t USING (session_id, signal, epoch, lag) GROUP BY ALL),
f AS (SELECT *, row_number() OVER b AS r, peak - lag(peak) OVER b AS gap FROM m WINDOW b AS (PARTITION BY session_id, signal, epoch ORDER BY peak)),
c AS (SELECT f.session_id, f.signal, f.epoch, f.peak, f.r, xt / tt AS a, coalesce((SELECT sum(x.t * y.t) FROM t x JOIN t y ON y.lag = x.lag + f.gap AND (x.session_id, x.signal, x.epoch) = (y.session_id, y.signal, y.epoch) WHERE (x.session_id, x.signal, x.epoch) = (f.session_id, f.signal, f.epoch)), 0) / tt AS c FROM f),
e AS (SELECT * FROM (WITH RECURSIVE g AS (SELECT session_id, signal, epoch, peak, r, a AS s FROM c WHERE r = 1 UNION ALL SELECT c.session_id, c.signal, c.epoch, c.peak, c.r, c.a - c.c * g.s FROM g JOIN c ON (c.session_id, c.signal, c.epoch) = (g.session_id, g.signal, g.epoch) AND c.r = g.r + 1) SELECT * FROM g)),
o AS (SELECT e.session_id, e.signal, e.peak + t.lag AS sample_idx, sum(e.s * t.t) AS g FROM e JOIN t USING (session_id, signal, epoch) GROUP BY ALL)
SELECT s.session_id, s.signal, s.sample_idx, round(s.value - coalesce(o.g, 0), 5) + 0.0 AS cleaned FROM s LEFT JOIN o USING (session_id, signal, sample_idx)""")
def beats_removed(spark, sf):
    d = H.remove_beats(samples(spark, sf).select(*KEYS, "sample_idx", "value"), beats(spark, sf), "session_id", "signal", epoch=100, window=8)
    return rounded(d.select(*KEYS, "sample_idx", "cleaned"), "cleaned", places=5).withColumn("cleaned", F.col("cleaned") + F.lit(0.0))


def _smooth(block: int, hop: int) -> str:
    """Tables h (the Haar details of pairs of samples) to x (their thresholds)."""
    return SQL + f""", h AS (SELECT session_id, signal, sample_idx // 2 AS k, (max(CASE WHEN sample_idx % 2 = 0 THEN value END) - max(CASE WHEN sample_idx % 2 = 1 THEN value END)) / sqrt(2) AS d FROM s GROUP BY ALL HAVING count(*) = 2),
z AS (SELECT session_id, signal, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT DISTINCT session_id, signal, n, least(i * {hop}, n - 1) AS c FROM z, range(0, 100000) r(i) WHERE i * {hop} < n + {hop} - 1),
t AS (SELECT h.session_id, h.signal, c, (median(abs(d)) / 0.6745) ** 2 / sqrt(greatest(avg(d * d) - (median(abs(d)) / 0.6745) ** 2, 1e-12)) AS t FROM h JOIN c ON h.session_id = c.session_id AND h.signal = c.signal AND k >= c - {block // 2} AND k < c + {block // 2} GROUP BY ALL),
l AS (SELECT *, lead(c) OVER w AS c2, lead(t) OVER w AS t2 FROM t WINDOW w AS (PARTITION BY session_id, signal ORDER BY c)),
x AS (SELECT h.*, t + coalesce((t2 - t) * (k - c) / (c2 - c), 0) AS t FROM h JOIN l ON h.session_id = l.session_id AND h.signal = l.signal AND k >= c AND (k < c2 OR c2 IS NULL))"""


@query("smooth_thresholds", _smooth(40, 10) + " SELECT session_id, signal, k, round(sign(d) * greatest(abs(d) - t, 0), 5) + 0.0 AS soft, round(CASE WHEN abs(d) > t THEN d ELSE 0 END, 5) + 0.0 AS hard FROM x")
def smooth_thresholds(spark, sf):
    at = lambda odd: F.max(F.when(F.col("sample_idx") % 2 == odd, F.col("value")))
    h = samples(spark, sf).groupBy(*KEYS, F.floor(F.col("sample_idx") / 2).alias("k")).agg(((at(0) - at(1)) / F.sqrt(F.lit(2.0))).alias("d"), F.count(F.lit(1)).alias("_two")).filter("_two = 2").drop("_two")
    h = h.join(h.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS)
    d = C.local_threshold(h, KEYS, "d", "k", n=F.col("n"), block=F.lit(40), hop=F.lit(10))
    hard = F.when(F.abs("d") > F.col("threshold"), F.col("d")).otherwise(0.0)
    d = rounded(d.select(*KEYS, "k", F.col("shrunk").alias("soft"), hard.alias("hard")), "soft", "hard", places=5)
    return d.withColumns({c: F.col(c) + F.lit(0.0) for c in ("soft", "hard")})


def _mirrored(half: int) -> str:
    """q (a place and a weight for each output j) to its sums; places outside of the series are mirrored about its ends."""
    return f"""z AS (SELECT session_id, signal, count(*) AS n, min_by(value, sample_idx) AS a, max_by(value, sample_idx) AS b FROM s GROUP BY ALL),
q AS (SELECT z.*, i, h, i0 + k - {half} AS p FROM z JOIN o USING (session_id, signal) JOIN t ON t.phase = o.phase),
y AS (SELECT q.session_id, q.signal, i, sum(h * coalesce(CASE WHEN p < 0 THEN 2 * a - value WHEN p >= n THEN 2 * b - value ELSE value END, 0)) AS y
      FROM q LEFT JOIN s ON s.session_id = q.session_id AND s.signal = q.signal AND s.sample_idx = CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END GROUP BY ALL)"""


def _weights(rows) -> str:
    return "t(phase, k, h) AS (VALUES " + ", ".join(f"({p}, {k}, {float(h)!r}::DOUBLE)" for p, w in enumerate(rows) for k, h in enumerate(w)) + ")"


TAPS = B.band_pass_taps(100.0, 10.0, 30.0)


@query("fir_band_pass", SQL + ", " + _weights([TAPS]) + ", o AS (SELECT session_id, signal, sample_idx AS i, sample_idx AS i0, 0 AS phase FROM s), " + _mirrored(len(TAPS) // 2) + " SELECT session_id, signal, i AS sample_idx, round(y, 5) + 0.0 AS filtered FROM y")
def fir_band_pass(spark, sf):
    d = B.fir_band_pass(samples(spark, sf), KEYS, fs=100.0, low=10.0, high=30.0, block=40)
    return rounded(d, "filtered", places=5).withColumn("filtered", F.col("filtered") + F.lit(0.0))


PHASES, HALF = B.resample_weights(2, 3, 8)


@query("resampled", SQL + ", " + _weights(PHASES) + ", c AS (SELECT session_id, signal, count(*) AS m FROM s GROUP BY ALL), o AS (SELECT session_id, signal, CAST(j AS BIGINT) AS i, j * 3 // 2 AS i0, j * 3 % 2 AS phase FROM c, range(0, 1000000) r(j) WHERE j < round_even(m * 2 / 3.0::DOUBLE, 0)), " + _mirrored(HALF) + " SELECT session_id, signal, i AS sample_idx, round(y, 5) + 0.0 AS value FROM y")
def resampled(spark, sf):
    d = B.resample(samples(spark, sf), KEYS, old=300, new=200, crossings=8, block=50)
    return rounded(d, "value", places=5).withColumn("value", F.col("value") + F.lit(0.0))


LINE = {"fs": 64.0, "freqs": [16.0], "seconds": 1.0, "bandwidth": 6.0, "p": 0.25, "rounds": 1}


def _line_sql() -> str:
    """Windows of 64 samples (the last takes up to 127) of each signal, and the F of a sine of a quarter turn a sample."""
    taper = ", ".join(f"({n}, {k}, {t}, {float(h)!r}::DOUBLE)" for n in (64,) for k, v in enumerate(L.tapers_for(n, 64.0, 6.0)) for t, h in enumerate(v))
    k = len(L.tapers_for(64, 64.0, 6.0))
    return SQL + f""", v(n, k, t, h) AS (VALUES {taper}), w AS (SELECT session_id, signal, CAST(sample_idx // 64 AS BIGINT) AS win, sample_idx, sample_idx % 64 AS t, value AS x, count(*) OVER (PARTITION BY session_id, signal) AS n FROM s),
f AS (SELECT * FROM w WHERE win < n // 64 - 1 OR n % 64 = 0), j AS (SELECT session_id, signal, win, k, sum(h * x * cos(t * pi() / 2)) AS re, -sum(h * x * sin(t * pi() / 2)) AS im FROM f JOIN v USING (t) GROUP BY ALL),
u AS (SELECT k, sum(h) AS u FROM v GROUP BY k), m AS (SELECT session_id, signal, win, sum(u * re) / sum(u * u) AS a, sum(u * im) / sum(u * u) AS b, sum(u * u) AS uu FROM j JOIN u USING (k) GROUP BY ALL),
r AS (SELECT session_id, signal, win, min(a) AS a, min(b) AS b, {k - 1} * min((a * a + b * b) * uu) / sum((re - a * u) ** 2 + (im - b * u) ** 2) AS f FROM m JOIN j USING (session_id, signal, win) JOIN u USING (k) GROUP BY ALL)"""


def _full_windows(spark, sf):
    """Samples of whole windows of 64 but for the last (which is longer), and the two tables of the test."""
    s = samples(spark, sf).select(*KEYS, "sample_idx", "value")
    n = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    whole = s.join(n, KEYS).filter((F.floor(F.col("sample_idx") / 64) < F.floor(F.col("n") / 64) - 1) | (F.col("n") % 64 == 0)).drop("n")
    return L.remove_tested_lines(whole, KEYS, **LINE)


@query("line_f_tests", _line_sql() + f" SELECT session_id, signal, win AS \"window\", 16.0::DOUBLE AS freq, round(f, 4) AS f, f > {L.critical_f(len(L.tapers_for(64, 64.0, 6.0)), 0.25)!r} AS significant FROM r")
def line_f_tests(spark, sf):
    t = _full_windows(spark, sf)[1]
    return rounded(t.select(*KEYS, "window", "freq", "f", (F.col("f") > F.col("critical")).alias("significant")), "f", places=4)


@query("lines_removed_if_found", _line_sql() + f" SELECT f.session_id, f.signal, sample_idx, round(CASE WHEN r.f > {L.critical_f(len(L.tapers_for(64, 64.0, 6.0)), 0.25)!r} THEN x - 2 * (a * cos(t * pi() / 2) - b * sin(t * pi() / 2)) ELSE x END, 5) + 0.0 AS cleaned FROM f JOIN r USING (session_id, signal, win)")
def lines_removed_if_found(spark, sf):
    d = rounded(_full_windows(spark, sf)[0], "cleaned", places=5)
    return d.withColumn("cleaned", F.col("cleaned") + F.lit(0.0))
