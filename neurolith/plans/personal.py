"""Queries of the personal report's series and fields over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import personal as R
from neurolith.plans.fixtures import SQL, samples, table
from neurolith.plans.quality import BASE, baseline, rounded
from neurolith.plans.registry import query

BANDS = ["theta", "alpha"]
# Vectors as epochs: the label's half is the session, its third the phase (a fourth has none), squares of values are powers in V^2.
EPOCHS = """WITH e AS (SELECT label // 4 AS session_id, CASE label % 4 WHEN 0 THEN 'REST_BEFORE' WHEN 1 THEN 'MEDITATION' WHEN 2 THEN 'REST_AFTER' END AS phase, vec_id AS epoch,
  CASE WHEN vec_id % 5 > 0 THEN embedding[1]::DOUBLE ** 2 * 1e-9 END AS a3, embedding[2]::DOUBLE ** 2 * 1e-9 AS a4, CASE WHEN vec_id % 7 > 0 THEN embedding[3]::DOUBLE ** 2 * 1e-9 END AS b3, CASE WHEN vec_id % 7 > 0 THEN embedding[4]::DOUBLE ** 2 * 1e-9 END AS b4, abs(embedding[5]::DOUBLE) AS rel FROM embeddings)"""


def epochs(spark, sf):
    at = lambda i: F.pow(F.get("embedding", F.lit(i)).cast("double"), F.lit(2.0)) * 1e-9
    phase = F.when(F.col("label") % 4 == 0, "REST_BEFORE").when(F.col("label") % 4 == 1, "MEDITATION").when(F.col("label") % 4 == 2, "REST_AFTER")
    alpha = lambda i: F.when(F.col("vec_id") % 7 > 0, at(i))
    return table(spark, sf, "embeddings").select(F.floor(F.col("label") / 4).alias("session_id"), phase.alias("phase"), F.col("vec_id").alias("epoch"), F.when(F.col("vec_id") % 5 > 0, at(0)).alias("AF3_theta"), at(1).alias("AF4_theta"), alpha(2).alias("AF3_alpha"), alpha(3).alias("AF4_alpha"), F.abs(F.get("embedding", F.lit(4)).cast("double")).alias("rel"))


@query("band_series", EPOCHS + """, r AS (SELECT *, CASE phase WHEN 'REST_BEFORE' THEN 0 WHEN 'MEDITATION' THEN 1 WHEN 'REST_AFTER' THEN 2 ELSE 99 END AS k FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k, epoch) - 1 AS place, count(*) OVER (PARTITION BY session_id) AS n FROM r)
SELECT session_id, CAST(place // ((n + 19) // 20) AS BIGINT) AS bin, max(n) AS n_epochs, round(avg(CASE WHEN k = 99 THEN -1 ELSE k END), 6) AS phase_bound, round(avg(list_avg(list_filter([a3, a4], lambda x: x IS NOT NULL)) * 1e12), 3) AS theta, round(avg(list_avg(list_filter([b3, b4], lambda x: x IS NOT NULL)) * 1e12), 3) AS alpha FROM p GROUP BY ALL""")
def band_series(spark, sf):
    return rounded(R.band_series(epochs(spark, sf), "session_id", BANDS, most=20), "phase_bound")


@query("onset_series", EPOCHS + """, m AS (SELECT session_id, row_number() OVER w - 1 AS place, (coalesce(lag(rel) OVER w, 0) + rel + coalesce(lead(rel) OVER w, 0)) / 3 AS y FROM e WHERE phase = 'MEDITATION' WINDOW w AS (PARTITION BY session_id ORDER BY epoch)),
o AS (SELECT session_id, median(rel) AS threshold, CAST(count(*) AS DOUBLE) AS latency, count(*) > 10 AS reached FROM e WHERE phase = 'REST_BEFORE' AND session_id > 0 GROUP BY 1)
SELECT m.session_id, place, round(place * 2.0::DOUBLE, 1) AS t, round(y, 5) AS smoothed, round(threshold, 5) AS threshold, latency, reached FROM m LEFT JOIN o ON m.session_id = o.session_id""")
def onset_series(spark, sf):
    e = epochs(spark, sf)
    o = e.filter("phase = 'REST_BEFORE' AND session_id > 0").groupBy("session_id").agg(F.median("rel").alias("threshold"), F.count(F.lit(1)).cast("double").alias("latency"), (F.count(F.lit(1)) > 10).alias("reached"))
    return R.onset_series(e.filter("phase = 'MEDITATION'"), o, "session_id", "rel")


@query("relaxation_onset", BASE + """, o AS (SELECT *, CASE WHEN min(smoothed) OVER w >= baseline AND count(*) OVER w = 3 THEN sample_idx END AS hit FROM sm WINDOW w AS (PARTITION BY session_id, signal ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
g AS (SELECT session_id, signal, count(*) AS n_epochs, CASE WHEN count(*) >= 6 THEN min(hit) END AS onset_idx FROM o GROUP BY ALL)
SELECT *, onset_idx IS NOT NULL AS onset_reached, onset_idx * 2.0::DOUBLE AS onset_seconds, n_epochs * 2.0::DOUBLE AS duration_seconds, round(onset_idx * 100.0::DOUBLE / n_epochs, 6) AS onset_percent FROM g""")
def relaxation_onset(spark, sf):
    s = samples(spark, sf)
    return rounded(R.relaxation_onset(s, baseline(s)), "onset_percent")


@query("joined_with_suffixes", "SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS name_l1, round(o_totalprice, 2) AS amount_l1, c_name AS name_l2, round(c_acctbal, 2) AS amount_l2, c_mktsegment AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def joined_with_suffixes(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.round("o_totalprice", 2).alias("amount"))
    b = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("amount"), F.col("c_mktsegment").alias("segment"))
    return R.joined_with_suffixes(a, b, ["k"])


FEATURES = {"price": "l_extendedprice", "quantity": "l_quantity", "tax": "l_tax"}


def by_phase(spark, sf):
    """Orders with a mean of three measures for lines 1 to 3, as features in three phases; some orders lack some."""
    d = table(spark, sf, "lineitem").filter("l_linenumber <= 3")
    return d.groupBy("l_orderkey").agg(*[F.avg(F.when(F.col("l_linenumber") == i + 1, F.col(c))).alias(f"{n}__{p}") for n, c in FEATURES.items() for i, p in enumerate(X.PHASES)])


BY_PHASE = "WITH x AS (SELECT l_orderkey, " + ", ".join(f"avg(CASE WHEN l_linenumber = {i + 1} THEN {c} END) AS {n}{i}" for n, c in FEATURES.items() for i in range(3)) + " FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)"
POOL = ", u AS (" + " UNION ALL ".join(f"SELECT price{i} AS price, quantity{i} AS quantity, tax{i} AS tax FROM x" for i in range(3)) + "), m AS (SELECT " + ", ".join(f"avg({n}) AS m{n}, stddev_pop({n}) AS s{n}" for n in FEATURES) + " FROM u)"


@query("pooled_composite", BY_PHASE + POOL + " SELECT l_orderkey, " + ", ".join(f"CASE WHEN price{i} IS NOT NULL AND quantity{i} IS NOT NULL AND tax{i} IS NOT NULL THEN round(((price{i} - mprice) / sprice - (quantity{i} - mquantity) / squantity + (tax{i} - mtax) / stax) / 3, 3) + 0.0 END AS composite__{p}" for i, p in enumerate(X.PHASES)) + " FROM x, m")
def pooled_composite(spark, sf):
    d = R.pooled_composite(by_phase(spark, sf), list(FEATURES), list(X.PHASES), {"quantity": -1}, least=3)
    return d.select("l_orderkey", *[(F.col(f"composite__{p}") + F.lit(0.0)).alias(f"composite__{p}") for p in X.PHASES])


@query("dashboard_fields", BY_PHASE + " SELECT l_orderkey, round(price0, 4) AS lf_hf__REST_BEFORE, round(price1, 4) AS lf_hf__MEDITATION, round(tax2, 5) AS engage_REST_AFTER, CAST(NULL AS DOUBLE) AS alpha_MEDITATION FROM x")
def dashboard_fields(spark, sf):
    return R.renamed_fields(by_phase(spark, sf), ["l_orderkey"], {"lf_hf__REST_BEFORE": ("price__REST_BEFORE", 4), "lf_hf__MEDITATION": ("price__MEDITATION", 4), "engage_REST_AFTER": ("tax__REST_AFTER", 5), "alpha_MEDITATION": ("alpha__MEDITATION", 4)})


@query("session_folders", "SELECT o_custkey AS participant_key, 1 + o_orderkey % 12 AS study_day, min(o_orderkey) AS session_id, '/data/participant=' || o_custkey || '/study_day=' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR), 2, '0') || '/session_id=' || min(o_orderkey) AS folder FROM orders GROUP BY o_custkey, 1 + o_orderkey % 12")
def session_folders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("participant_key"), (1 + F.col("o_orderkey") % 12).alias("study_day"), F.col("o_orderkey").alias("session_id"))
    return R.session_folders(o, "/data/")


@query("sliding_finite_windows", SQL + ", e AS (SELECT session_id, signal, CASE WHEN event_id % 11 > 0 THEN value END AS value, unnest(range(greatest(0, CAST(floor((sample_idx - 40) / 10.0) AS BIGINT) + 1), CAST(floor(sample_idx / 10.0) AS BIGINT) + 1)) AS win FROM s) SELECT session_id, signal, win AS \"window\", count(*) AS n, count(value) AS n_finite, round(avg(value), 6) AS mean FROM e GROUP BY ALL HAVING count(*) = 40 AND count(value) >= 0.95 * 40")
def sliding_finite_windows(spark, sf):
    s = samples(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 > 0, F.col("value")))
    return rounded(X.sliding_windows(s, ["session_id", "signal"], 40, 10, least_finite=0.95), "mean")


@query("long_thirds", SQL + ", g AS (SELECT session_id, signal, min(sample_idx) AS a, max(sample_idx) + 1 AS b FROM ph WHERE phase = 'MEDITATION' GROUP BY ALL HAVING count(*) >= 0.3 * 375) SELECT session_id, signal, CAST(k AS INT) AS part, CAST(a + round_even((b - a) * k / 3.0::DOUBLE, 0) AS BIGINT) AS part_start, CAST(a + round_even((b - a) * (k + 1) / 3.0::DOUBLE, 0) AS BIGINT) AS part_stop FROM g, range(3) t(k)")
def long_thirds(spark, sf):
    from neurolith.plans.fixtures import phases

    g = phases(spark, sf).filter("phase = 'MEDITATION'").groupBy("session_id", "signal").agg(F.min("sample_idx").alias("a"), (F.max("sample_idx") + 1).alias("b"))
    return X.thirds(g, "a", "b", least=0.3 * 375).select("session_id", "signal", "part", "part_start", "part_stop")
