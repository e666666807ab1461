"""Queries of wavelet transforms: features of vectors, and cleaning of the sample stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import wavelets as V
from neurolith.plans.fixtures import SQL, samples, table
from neurolith.plans.quality import rounded
from neurolith.plans.registry import query

KEYS = ["session_id", "signal"]


def _taps(low: list[float], high: list[float]) -> str:
    return ", ".join(f"({j}, {low[j]!r}::DOUBLE, {high[j]!r}::DOUBLE)" for j in range(len(low)))


def _symmetric(level: int, n: int) -> str:
    """Tables d1 to d<level> and a<level> from a0 (vec_id, k, x) of n values each."""
    low, high, _, _ = V.filters("db4")
    out = f"taps(j, lo, hi) AS (VALUES {_taps(low, high)})"
    for l in range(1, level + 1):
        m, n = n, (n + 7) // 2
        out += f""", e{l} AS (SELECT vec_id, unnest([k, -k - 1, {2 * m - 1} - k]) AS q, x FROM a{l - 1}),
c{l} AS (SELECT vec_id, (q + j - 1) // 2 AS k, sum(lo * x) AS x, sum(hi * x) AS d FROM e{l}, taps WHERE (q + j - 1) % 2 = 0 AND (q + j - 1) BETWEEN 0 AND {2 * n - 1} GROUP BY ALL), a{l} AS (SELECT vec_id, k, x FROM c{l}), d{l} AS (SELECT vec_id, k, d AS x FROM c{l})"""
    return out


def _features(source: str, level: int, n: int) -> str:
    """The measures of all bands of a0 (source: its SELECT) down to `level`, each band of at most 256 coefficients."""
    subs = " UNION ALL ".join([f"SELECT vec_id, 0 AS sub, k, x FROM a{level}", *[f"SELECT vec_id, {level - l + 1}, k, x FROM d{l}" for l in range(level, 0, -1)]])
    lengths = " UNION ALL ".join(f"SELECT vec_id, sub, {s} AS s, sum(abs(x - before{s}) * (n - 1) / ({s**3}.0::DOUBLE * ((n - k % {s} - 1) // {s}))) AS l FROM y WHERE n >= {3 * s} AND k >= {s} AND k // {s} < (n - k % {s} - 1) // {s} GROUP BY ALL" for s in range(1, 11))
    return f"WITH a0 AS ({source}), " + _symmetric(level, n) + f""",
b AS ({subs}),
w AS (SELECT *, count(*) OVER g AS n, sum(x * x) OVER g AS e, min(x) OVER g AS lo, max(x) OVER g AS hi, avg(x) OVER g AS mean FROM b WINDOW g AS (PARTITION BY vec_id, sub)),
h AS (SELECT vec_id, sub, n, coalesce(least(CAST(floor((x - lo) * 64 / nullif(hi - lo, 0)) AS BIGINT), 63), 32) AS bin, count(*) AS c, sum(ln(x * x + 1e-8)) AS g, sum(x * x / (e + 1e-8) * ln(x * x / (e + 1e-8) + 1e-8)) AS v FROM w GROUP BY ALL),
f AS (SELECT vec_id, sub, q, n, sum((x - mean) * (0.5 - 0.5 * cos(2 * pi() * k / n)) * cos(2 * pi() * q * k / n)) AS re, sum((x - mean) * (0.5 - 0.5 * cos(2 * pi() * k / n)) * sin(2 * pi() * q * k / n)) AS im FROM w JOIN range(0, 129) r(q) ON q <= n // 2 GROUP BY ALL),
p AS (SELECT *, (re * re + im * im) * CASE WHEN q = 0 OR 2 * q = n THEN 1 ELSE 2 END AS p FROM f), t AS (SELECT vec_id, sub, sum(p) AS s, count(*) AS m FROM p GROUP BY ALL),
u AS (SELECT vec_id, sub, -sum(CASE WHEN p > 0 THEN p / s * log2(p / s) ELSE 0 END) / log2(min(m)) AS spectral FROM p JOIN t USING (vec_id, sub) WHERE s > 0 GROUP BY ALL),
y AS (SELECT vec_id, sub, k, n, x, {', '.join(f'lag(x, {s}) OVER o AS before{s}' for s in range(1, 11))} FROM w WINDOW o AS (PARTITION BY vec_id, sub ORDER BY k)),
z AS (SELECT vec_id, sub, regr_slope(ln(l), -ln(s)) AS higuchi FROM ({lengths}) WHERE l > 0 GROUP BY ALL)
SELECT h.vec_id, CAST(h.sub AS INT) AS sub, n AS n_coefficients, round(sum(g), 5) AS log_energy, round(CASE WHEN n >= 8 THEN -sum(c / (n + 1e-12) * ln(c / (n + 1e-12) + 1e-12)) ELSE 0 END, 5) AS shannon_entropy, round(-sum(v), 5) AS wavelet_entropy,
       round(min(spectral), 5) AS spectral_entropy, round(min(higuchi), 5) AS higuchi_dimension FROM h LEFT JOIN u ON h.vec_id = u.vec_id AND h.sub = u.sub LEFT JOIN z ON h.vec_id = z.vec_id AND h.sub = z.sub GROUP BY h.vec_id, h.sub, n"""


MEASURES = ("log_energy", "shannon_entropy", "wavelet_entropy", "spectral_entropy", "higuchi_dimension")


@query("dwt_features", _features("SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings", 3, 64))
def dwt_features(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample_idx", "value"))
    c = V.decompose(e, ["vec_id"], wavelet="db4", level=5)
    return rounded(V.wavelet_features(c, ["vec_id"]), *MEASURES, places=5)


@query("dwt_series_features", _features("SELECT vec_id // 4 AS vec_id, unnest(embedding)::DOUBLE AS x, 64 * (vec_id % 4) + generate_subscripts(embedding, 1) - 1 AS k FROM embeddings", 5, 256))
def dwt_series_features(spark, sf):
    """Four vectors in a row are a series of 256 values, which all five levels divide; where some of them are missing, so are the
    coefficients that none of the others reaches."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("vec_id"), (64 * (F.col("vec_id") % 4)).alias("_o"), F.posexplode("embedding").alias("_i", "value"))
    c = V.decompose(e.select("vec_id", (F.col("_o") + F.col("_i")).alias("sample_idx"), "value"), ["vec_id"], wavelet="db4", level=5, length=256)
    return rounded(V.wavelet_features(c, ["vec_id"]), *MEASURES, places=5)


def _clean(level: int, fs: float, seconds: float) -> str:
    low, high, back, up = V.filters("bior4.4")
    n = len(low)
    out = f""", t(j, lo, hi) AS (VALUES {_taps(low, high)}), r(j, lo, hi) AS (VALUES {_taps(back, up)}),
z AS (SELECT session_id, signal, count(*) AS n FROM s GROUP BY ALL), a0 AS (SELECT session_id, signal, n, sample_idx AS k, value AS x FROM s JOIN z USING (session_id, signal))"""
    for l in range(1, level + 1):
        m = f"CAST(ceil(n / {2 ** (l - 1)}.0::DOUBLE) AS BIGINT)"
        half = f"CAST(ceil(n / {2 ** l}.0::DOUBLE) AS BIGINT)"
        out += f""", e{l} AS (SELECT session_id, signal, n, x, unnest(CASE WHEN {m} % 2 = 1 AND k = {m} - 1 THEN [k, k + 1] ELSE [k] END) AS q FROM a{l - 1} WHERE n >= {(n - 1) * 2 ** l}),
c{l} AS (SELECT session_id, signal, n, ((q + j - {n // 2}) // 2 + 64 * {half}) % {half} AS k, sum(lo * x) AS x, sum(hi * x) AS d FROM e{l}, t WHERE (q + j + {n // 2}) % 2 = 0 GROUP BY ALL), a{l} AS (SELECT session_id, signal, n, k, x FROM c{l}),
p{l} AS (SELECT *, greatest(1, CAST(round_even({half} / {max(1, round(seconds * fs / 2**l))}.0::DOUBLE, 0) AS BIGINT)) AS parts, {half} AS len FROM c{l}),
b{l} AS (SELECT session_id, signal, n, k, d, CASE WHEN k < len % parts * (len // parts + 1) THEN k // (len // parts + 1) ELSE len % parts + (k - len % parts * (len // parts + 1)) // greatest(len // parts, 1) END AS block FROM p{l}),
h{l} AS (SELECT session_id, signal, block, (median(abs(d)) / 0.6745) ** 2 / sqrt(greatest(avg(d * d) - (median(abs(d)) / 0.6745) ** 2, 1e-12)) AS h FROM b{l} GROUP BY ALL),
d{l} AS (SELECT b.session_id, b.signal, n, k, sign(d) * greatest(abs(d) - h, 0) AS x FROM b{l} b JOIN h{l} h ON b.session_id = h.session_id AND b.signal = h.signal AND b.block = h.block)"""
    out += f", r{level} AS (SELECT *, 0.0::DOUBLE AS low FROM d{level})"
    for l in range(level, 0, -1):
        m = f"CAST(ceil(n / {2 ** (l - 1)}.0::DOUBLE) AS BIGINT)"
        out += f""", u{l} AS (SELECT session_id, signal, n, (2 * k + j - {n // 2 - 1} + 64 * ({m} + {m} % 2)) % ({m} + {m} % 2) AS k, sum(x * hi + low * lo) AS x FROM r{l}, r GROUP BY ALL), v{l} AS (SELECT * FROM u{l} WHERE k < {m})"""
        if l > 1:
            out += f", r{l - 1} AS (SELECT d.*, coalesce(v.x, 0) AS low FROM d{l - 1} d LEFT JOIN v{l} v ON d.session_id = v.session_id AND d.signal = v.signal AND d.k = v.k)"
    return out + " SELECT s.session_id, s.signal, s.sample_idx, round(coalesce(v1.x, 0), 4) + 0.0 AS artifact, round(s.value - coalesce(v1.x, 0), 4) + 0.0 AS cleaned FROM s LEFT JOIN v1 ON s.session_id = v1.session_id AND s.signal = v1.signal AND s.sample_idx = v1.k"


@query("wavelet_clean", SQL + _clean(4, 244.0, 0.5))
def wavelet_clean(spark, sf):
    d = V.wavelet_clean(samples(spark, sf), KEYS, fs=244.0, wavelet="bior4.4", level=4, block_seconds=0.5)
    d = rounded(d.select(*KEYS, "sample_idx", "artifact", "cleaned"), "artifact", "cleaned", places=4)
    return d.withColumns({c: F.col(c) + F.lit(0.0) for c in ("artifact", "cleaned")})
