"""Spectral queries over the sample stream; their twins spell the transform out in sines and cosines."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import spectra as P
from neurolith.plans.fixtures import SQL, samples
from neurolith.plans.registry import query

FS, SIZE = 128.0, 32
KEYS = ["session_id", "signal"]


def _segments(step: int) -> str:
    return f"""sg AS (SELECT s.*, unnest(range(CAST(greatest(0, ceil((sample_idx - {SIZE - 1}) / {step}.0)) AS BIGINT), sample_idx // {step} + 1)) AS segment FROM s),
sf AS (SELECT *, sample_idx - segment * {step} AS j, value - avg(value) OVER g AS c, count(*) OVER g AS n FROM sg WINDOW g AS (PARTITION BY session_id, signal, segment)),
tr AS (SELECT session_id, signal, segment, k AS bin, sum(c * (0.5 - 0.5 * cos(2 * pi() * j / {SIZE})) * cos(2 * pi() * k * j / {SIZE})) AS re, -sum(c * (0.5 - 0.5 * cos(2 * pi() * j / {SIZE})) * sin(2 * pi() * k * j / {SIZE})) AS im FROM sf, range({SIZE // 2 + 1}) t(k) WHERE n = {SIZE} GROUP BY ALL)"""


#: The sum of a squared periodic Hann window is 3/8 of its length.
SCALE = f"(CASE WHEN bin = 0 OR bin = {SIZE // 2} THEN 1.0 ELSE 2.0 END / {FS * SIZE * 3 / 8})"
DENSITY = SQL + ", " + _segments(SIZE // 2) + f", d AS (SELECT session_id, signal, bin, avg(re * re + im * im) * {SCALE} AS power, bin * {FS / SIZE} AS freq FROM tr GROUP BY session_id, signal, bin)"


def density(spark, sf):
    return P.power_density(samples(spark, sf), KEYS, fs=FS, size=SIZE)


def area(low: float, high: float, closed: bool = True) -> str:
    w = f"FILTER (freq >= {low} AND freq {'<=' if closed else '<'} {high})"
    return f"CASE WHEN count(*) {w} > 1 THEN (sum(power) {w} - (arg_min(power, freq) {w} + arg_max(power, freq) {w}) / 2) * {FS / SIZE} WHEN count(*) {w} = 1 THEN 0.0 END"


def placed(df, *columns, digits: int = 6):
    """Rounded to some places, as its twin is."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("power_density", DENSITY + " SELECT session_id, signal, CAST(bin AS INT) AS bin, freq, round(power, 5) AS power FROM d")
def power_density(spark, sf):
    return placed(density(spark, sf), "power", digits=5).select(*KEYS, "bin", "freq", "power")


_B = [*P.BANDS]


@query("band_powers", DENSITY + ", b AS (SELECT session_id, signal, " + area(1, 45) + " AS total, " + ", ".join(f"{area(*P.BANDS[b])} AS {b}" for b in _B) + " FROM d GROUP BY ALL) SELECT session_id, signal, round(total, 4) AS total, " + ", ".join(f"round({b}, 4) AS {b}, round(CASE WHEN total > 0 THEN {b} / total END, 6) AS {b}_rel" for b in _B) + ", round(CASE WHEN alpha > 0 THEN theta / alpha END, 5) AS theta_alpha_ratio, round(CASE WHEN alpha + beta > 0 THEN theta / (alpha + beta) END, 5) AS theta_alpha_beta_ratio FROM b")
def band_powers(spark, sf):
    d = P.band_powers(density(spark, sf), KEYS)
    d = placed(d, "total", *_B, digits=4)
    return placed(placed(d, *[f"{b}_rel" for b in _B]), "theta_alpha_ratio", "theta_alpha_beta_ratio", digits=5)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


@query("qc_spectral_ratios", DENSITY + f", q AS (SELECT session_id, signal, {area(49, 51, False)} AS l, {area(45, 49, False)} AS m, {area(51, 55, False)} AS n, {area(0.8, 2.5, False)} AS p, {area(0.5, 5, False)} AS o, {area(1, 4, False)} AS e, {area(1, 45, False)} AS t FROM d GROUP BY ALL) SELECT session_id, signal, round({_ratio('l', '(m + n)')}, 5) AS line_noise_ratio, round({_ratio('p', 'o')}, 5) AS pulsatility, round({_ratio('e', 't')}, 5) AS low_ratio FROM q")
def qc_spectral_ratios(spark, sf):
    return placed(P.quality_ratios(density(spark, sf), KEYS, FS), "line_noise_ratio", "pulsatility", "low_ratio", digits=5)


PEAKS = DENSITY + ", n AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM d WHERE freq BETWEEN {lo} AND {hi} WINDOW w AS (PARTITION BY session_id, signal ORDER BY bin)), pk AS (SELECT * FROM n WHERE power > a AND power > b)"


@query("dominant_frequencies", PEAKS.format(lo=0.3, hi=64) + " SELECT session_id, signal, CAST(row_number() OVER w AS INT) AS rank, round(freq, 2) AS freq, round(power, 5) AS power FROM pk WINDOW w AS (PARTITION BY session_id, signal ORDER BY power DESC, bin) QUALIFY row_number() OVER w <= 5")
def dominant_frequencies(spark, sf):
    return placed(P.dominant_frequencies(density(spark, sf), KEYS, most_freq=64), "power", digits=5)


@query("alpha_peak", PEAKS.format(lo=4, hi=60) + """, e AS (SELECT k.session_id, k.signal, k.bin, k.freq, k.power, max(n.power) AS most, max(CASE WHEN n.bin < k.bin AND n.power > k.power THEN n.bin END) AS l, min(CASE WHEN n.bin > k.bin AND n.power > k.power THEN n.bin END) AS r FROM pk k JOIN n ON k.session_id = n.session_id AND k.signal = n.signal GROUP BY ALL),
v AS (SELECT e.session_id, e.signal, e.bin, e.freq, e.power, most, e.power - greatest(min(CASE WHEN n.bin < e.bin AND n.bin > coalesce(l, -1) THEN n.power END), min(CASE WHEN n.bin > e.bin AND n.bin < coalesce(r, 999) THEN n.power END)) AS prominence FROM e JOIN n ON e.session_id = n.session_id AND e.signal = n.signal GROUP BY e.session_id, e.signal, e.bin, e.freq, e.power, most, l, r)
SELECT session_id, signal, freq AS peak_freq, round(power, 5) AS peak_power, round(prominence, 5) AS peak_prominence FROM v WHERE prominence >= greatest(0.1 * most, 1e-12) QUALIFY row_number() OVER (PARTITION BY session_id, signal ORDER BY power DESC, bin) = 1""")
def alpha_peak(spark, sf):
    return placed(P.band_peak(density(spark, sf), KEYS, 4, 60), "peak_power", "peak_prominence", digits=5)


@query("renyi_entropy", DENSITY + ", q AS (SELECT *, power / sum(power) OVER (PARTITION BY session_id, signal) AS q FROM d) SELECT session_id, signal, round(-log2(sum(q * q)), 6) AS renyi_entropy, round(-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(count(*)), 6) AS spectral_entropy FROM q GROUP BY ALL")
def renyi_entropy(spark, sf):
    return placed(P.spectral_entropies(density(spark, sf), KEYS), "renyi_entropy", "spectral_entropy")


@query("band_power_sums", DENSITY + " SELECT session_id, signal, round(sum(power) FILTER (freq BETWEEN 8 AND 12), 5) AS alpha_sum, round(sum(power) FILTER (freq BETWEEN 13 AND 30), 5) AS beta_sum, round(ln(greatest(sum(power) FILTER (freq BETWEEN 8 AND 12), 1e-8)), 6) AS alpha_log FROM d GROUP BY ALL")
def band_power_sums(spark, sf):
    d = density(spark, sf).groupBy(*KEYS).agg(P.summed(8, 12).alias("alpha_sum"), P.summed(13, 30).alias("beta_sum"))
    d = d.withColumn("alpha_log", F.ln(F.greatest("alpha_sum", F.lit(1e-8))))
    return placed(placed(d, "alpha_sum", "beta_sum", digits=5), "alpha_log")


@query("spectral_outliers", DENSITY + ", m AS (SELECT session_id, signal, avg(log10(greatest(power, 1e-30))) AS m FROM d WHERE freq BETWEEN 1 AND 100 GROUP BY ALL), z AS (SELECT *, (m - avg(m) OVER w) / greatest(stddev_pop(m) OVER w, 1e-12) AS z FROM m WINDOW w AS (PARTITION BY session_id)) SELECT session_id, signal, round(m, 6) AS mean_log_power, round(z, 5) AS z, z < -1.2 OR z > 1.2 AS spectral_outlier FROM z")
def spectral_outliers(spark, sf):
    d = P.spectral_outliers(density(spark, sf), ["session_id"], "signal", z_low=-1.2, z_high=1.2)
    return placed(placed(d, "mean_log_power"), "z", digits=5)


@query("line_noise_outliers", DENSITY + ", g AS (SELECT session_id, signal, 10 * log10(greatest(avg(power) FILTER (abs(freq - 48) <= 4), 1e-30) / greatest(avg(power) FILTER (abs(freq - 48) > 4 AND abs(freq - 48) <= 20), 1e-30)) AS db FROM d GROUP BY ALL), z AS (SELECT *, (db - median(db) OVER w) / greatest(stddev_pop(db) OVER w, 1e-12) AS z FROM g WINDOW w AS (PARTITION BY session_id)) SELECT session_id, signal, round(db, 6) AS line_db, round(z, 5) AS z, z > 1 AS line_noise_outlier FROM z")
def line_noise_outliers(spark, sf):
    d = P.line_noise_outliers(density(spark, sf), ["session_id"], "signal", line=48, width=4, around=20, most_z=1)
    return placed(placed(d, "line_db"), "z", digits=5)


CROSS = SQL + ", " + _segments(SIZE // 2) + f", cx AS (SELECT a.session_id, a.bin, avg(a.re * a.re + a.im * a.im) * {SCALE.replace('bin', 'a.bin')} AS pxx, avg(b.re * b.re + b.im * b.im) * {SCALE.replace('bin', 'a.bin')} AS pyy, avg(a.re * b.re + a.im * b.im) * {SCALE.replace('bin', 'a.bin')} AS cr, avg(a.re * b.im - a.im * b.re) * {SCALE.replace('bin', 'a.bin')} AS ci, a.bin * {FS / SIZE} AS freq FROM tr a JOIN tr b ON a.session_id = b.session_id AND a.segment = b.segment AND a.bin = b.bin WHERE a.signal = 'AF3' AND b.signal = 'AF4' GROUP BY a.session_id, a.bin)"


def cross(spark, sf):
    s = samples(spark, sf).filter(F.col("signal").isin("AF3", "AF4"))
    at = lambda x: F.max(F.when(F.col("signal") == x, F.col("value")))
    both = s.groupBy("session_id", "sample_idx").agg(at("AF3").alias("x"), at("AF4").alias("y"))
    return P.cross_density(both, ["session_id"], "x", "y", fs=FS, size=SIZE)


_COH, _ICOH = "(cr * cr + ci * ci) / (pxx * pyy)", "abs(ci) / sqrt(pxx * pyy)"


@query("band_coherence", CROSS + " SELECT session_id, " + ", ".join(f"round(avg({x}) FILTER (freq BETWEEN {lo} AND {hi}), 6) AS {n}_{b}" for n, x in (("coherence", _COH), ("imaginary_coherency", _ICOH)) for b, (lo, hi) in (("alpha", (8, 12)), ("beta", (13, 30)))) + " FROM cx GROUP BY ALL")
def band_coherence(spark, sf):
    d = P.band_coherence(cross(spark, sf), ["session_id"], {"alpha": (8, 12), "beta": (13, 30)})
    return placed(d, *[c for c in d.columns if c != "session_id"])


@query("cross_features", CROSS + """, xy AS (SELECT session_id, sample_idx, max(CASE WHEN signal = 'AF3' THEN value END) AS x, max(CASE WHEN signal = 'AF4' THEN value END) AS y FROM s GROUP BY ALL), ve AS (SELECT session_id, abs(x) + 1e-8 AS x, abs(y) + 1e-8 AS y FROM xy WHERE x IS NOT NULL AND y IS NOT NULL),
en AS (SELECT session_id, ln(sum(x)) - sum(x * ln(x)) / sum(x) AS hx, ln(sum(y)) - sum(y * ln(y)) / sum(y) AS hy FROM ve GROUP BY 1),
fe AS (SELECT session_id, ln(sum(pyy) FILTER (freq BETWEEN 8 AND 12) + 1e-8) - ln(sum(pxx) FILTER (freq BETWEEN 8 AND 12) + 1e-8) AS faa, sum(pxx + pyy) FILTER (freq BETWEEN 13 AND 30) / (sum(pxx + pyy) FILTER (freq BETWEEN 4 AND 7 OR freq BETWEEN 8 AND 12) + 1e-8) AS fei, avg((cr * cr + ci * ci) / (pxx * pyy)) FILTER (freq BETWEEN 8 AND 12) AS ca, avg((cr * cr + ci * ci) / (pxx * pyy)) FILTER (freq BETWEEN 13 AND 30) AS cb FROM cx GROUP BY 1)
SELECT session_id, round(hx - hy, 6) + 0.0 AS entropy_difference, round(hx + hy, 6) AS entropy_sum, round(faa, 6) + 0.0 AS alpha_asymmetry, round(fei, 6) AS engagement_index, round(ca, 6) AS coherence_alpha, round(cb, 6) AS coherence_beta FROM en LEFT JOIN fe USING (session_id)""")
def cross_features(spark, sf):
    s = samples(spark, sf).filter(F.col("signal").isin("AF3", "AF4"))
    at = lambda x: F.max(F.when(F.col("signal") == x, F.col("value")))
    d = P.cross_features(s.groupBy("session_id", "sample_idx").agg(at("AF3").alias("x"), at("AF4").alias("y")), ["session_id"], fs=FS, size=SIZE)
    return placed(d, "entropy_difference", "entropy_sum", "alpha_asymmetry", "engagement_index", "coherence_alpha", "coherence_beta")


@query("coherence_at_line", CROSS + f", t AS (SELECT * FROM (VALUES (10.0), (48.0), (50.0), (52.0)) v(target)) SELECT session_id, CAST(target AS DOUBLE) AS target, freq, round({_COH}, 6) AS value FROM cx, t QUALIFY row_number() OVER (PARTITION BY session_id, target ORDER BY abs(freq - target), bin) = 1")
def coherence_at_line(spark, sf):
    v = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("pxx") * F.col("pyy"))
    return placed(P.nearest_bin(cross(spark, sf), ["session_id"], [10, *P.line_frequencies(50.0, [], [2.0])[:3]], v), "value")


LOW = SQL + ", " + _segments(8) + f", w AS (SELECT session_id, signal, segment, bin, (re * re + im * im) * {SCALE} AS power, bin * {FS / SIZE} AS freq FROM tr), r AS (SELECT session_id, signal, segment, {_ratio(area(4, 16), area(4, 60))} AS r FROM w GROUP BY ALL) SELECT session_id, signal, round(median(r), 6) AS low_freq_power_ratio, count(r) AS n_windows FROM r GROUP BY ALL"


@query("windowed_low_ratio", LOW)
def windowed_low_ratio(spark, sf):
    return placed(P.windowed_low_ratio(samples(spark, sf), KEYS, fs=FS, size=SIZE, step=8, low=(4, 16), total=(4, 60)), "low_freq_power_ratio")
