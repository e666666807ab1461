"""Tables of a study put together: tolerant columns, lookups, reshapes, phases, windows and summaries."""

from __future__ import annotations

import functools
import math
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- columns ---------------------------------------------------------------------------------------------------------


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the order wanted."""
    return df.select(*[c for c in wanted if c in df.columns])


def in_front(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns first (those that are there) before all others."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def matching(df: DataFrame, *patterns: str) -> list[str]:
    """The columns that match any of the patterns, each once, in the table's order."""
    return [c for c in df.columns if any(re.search(p, c) for p in patterns)]


def rank_of(value: Column, order: list[str], otherwise: int = 99) -> Column:
    """The place of a value in a fixed order."""
    out = F.lit(otherwise)
    for i, x in reversed(list(enumerate(order))):
        out = F.when(value == x, i).otherwise(out)
    return out


def clipped_percent(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def distinct_reasons(*reasons: Column) -> Column:
    """Reasons in order of their first mention, each once, `;` between them; empty ones and nulls are left out."""
    return F.array_join(F.array_distinct(F.filter(F.array(*reasons), lambda r: r.isNotNull() & (r != ""))), ";")


def adc_to_volts(counts: Column, bits: int = 24, vref: float = 2.4) -> Column:
    """Counts of an offset-binary converter as volts."""
    half = float(2 ** (bits - 1))
    return (counts - half) * vref / half / 2


def adc_scaled(counts: Column, bits: int = 24, vref: float = 2.4) -> Column:
    """Counts of an AC-coupled signal as microvolts: scaled only, no midpoint removed."""
    return counts * 1e6 * vref / float(2 ** (bits - 1)) / 2


# --- reading and joining ----------------------------------------------------------------------------------------------


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with a header, or an empty one of that schema if there is none at the path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def join_optional(left: DataFrame, right: DataFrame | None, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """left with the columns (name: type) of right on a left join; nulls of these types where right, or a column, is absent."""
    if right is None:
        return left.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    have = right.select(*keys, *[(F.col(c) if c in right.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    return left.join(have, keys, "left")


def last_of(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row for each key, its last in the order: what a lookup that later rows overwrite ends with. One aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def preferred(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, whole."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def in_segments(samples: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """samples joined with the segments (keys, start_idx, stop_idx, ...) that hold them, start inclusive, stop exclusive.

    The join is on the keys and the range; a key has few segments, so a sample meets only those of its own recording.
    """
    s = segments.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in segments.columns if c not in keys])
    return samples.join(s, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("sample_idx") >= F.col("start_idx"), F.col("sample_idx") < F.col("stop_idx")]).drop(*[f"_{k}" for k in keys])


def grid(rows: DataFrame, participant: str, day: str, value: str, order: list[Column]) -> DataFrame:
    """A row for every participant and every day that anyone has, with the first value in order or null.

    Days are a short list: they are collected into one row by an aggregate and spread over the participants.
    """
    days = rows.agg(F.array_sort(F.collect_set(day)).alias("_days"))
    cells = rows.select(participant).distinct().crossJoin(F.broadcast(days)).select(participant, F.explode("_days").alias(day))  # one row on the right
    first = rows.groupBy(participant, day).agg(F.min_by(value, F.struct(*order)).alias(value))
    return cells.join(first, [participant, day], "left")


# --- aggregates ------------------------------------------------------------------------------------------------------


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, std (n - 1), min, quartiles, max of what is not null.

    Quartiles are exact. A first pass takes two approximate quantiles about each of them, which part a column's values in seven;
    a second one counts the values up to the end of each part, which tells the parts where the quartiles' ranks are, mostly
    those between two near quantiles; a third one orders the distinct values of these parts only. Each pass gives one row.
    """
    quartiles, spark = (0.25, 0.5, 0.75), rows.sparkSession
    x = [F.col(f"_{i}") for i in range(len(columns))]
    d = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    near = lambda c: F.percentile_approx(c, [q + e for q in quartiles for e in (-0.0005, 0.0005)], 5000)
    whole = d.agg(F.count(F.lit(1)).alias("n"), *[F.struct(*[f(c) for f in (F.count, F.avg, F.stddev_samp, F.min, F.max, near)]).alias(f"_{i}") for i, c in enumerate(x)]).first()
    found = [tuple(whole[f"_{i}"]) for i in range(len(columns))]
    ends = []  # a column's parts: what tells that a value is not beyond each
    for c, (*_, at) in zip(x, found, strict=True):
        ends.append([])
        for k, bound in enumerate(at or []):
            here = c <= F.lit(bound) if k % 2 else c < F.lit(bound)
            ends[-1].append(ends[-1][-1] | here if k else here)
        ends[-1].append(c.isNotNull())
    upto = d.agg(*[F.array(*[F.count_if(e) for e in column]) for column in ends]).first()
    parts: dict[tuple[int, int], set[int]] = {}  # the ranks wanted of a column's part
    for i, (n, *_) in enumerate(found):
        for rank in {f((n - 1) * q) for q in quartiles for f in (math.floor, math.ceil)} if n else ():
            parts.setdefault((i, sum(u <= rank for u in upto[i])), set()).add(rank)
    schema = "_c int, metric string, count long, mean double, std double, min double, max double"
    out = spark.createDataFrame([(i, columns[i], *v[:5]) for i, v in enumerate(found)] if whole.n else [], schema)
    if parts:
        inside = [ends[i][k] & ~ends[i][k - 1] if k else ends[i][k] for i, k in parts]
        some = F.array(*[F.when(in_, F.struct(F.lit(g).alias("_g"), x[i].alias("_x"))) for g, ((i, _), in_) in enumerate(zip(parts, inside, strict=True))])
        v = d.filter(functools.reduce(operator.or_, inside)).select(F.explode(F.array_compact(some)).alias("_p")).groupBy("_p._g", "_p._x").agg(F.count(F.lit(1)).alias("_n"))
        about = [(g, i, upto[i][k - 1] if k else 0, sorted(ranks)) for g, ((i, k), ranks) in enumerate(parts.items())]
        v = v.withColumn("_end", F.sum("_n").over(Window.partitionBy("_g").orderBy("_x"))).join(F.broadcast(spark.createDataFrame(about, "_g int, _c int, _before long, _ranks array<long>")), "_g")
        end = F.col("_before") + F.col("_end")
        v = v.select("_c", "_x", F.explode(F.filter("_ranks", lambda r: (r >= end - F.col("_n")) & (r < end))).alias("_r"))
        out = out.join(v.groupBy("_c").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_at")), "_c", "left")
    else:
        out = out.withColumn("_at", F.lit(None).cast("map<bigint, double>"))

    def quantile(q: float) -> Column:
        place = (F.col("count") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)

    return out.select("metric", "count", "mean", "std", "min", *[quantile(q).alias(f"q{q * 100:.0f}") for q in quartiles], "max")


def run_counts(rows: DataFrame, group: str, ok: Column, tag: str, kept: Column) -> DataFrame:
    """Counters of a run: n_total, n_ok, percent_ok, and pre and post counts of each tag as maps."""
    per = rows.groupBy(group, tag).agg(F.count(F.lit(1)).alias("_pre"), F.count_if(kept).alias("_post"), F.count_if(ok).alias("_ok"))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(tag, c))))
    total, n_ok = F.sum("_pre"), F.sum("_ok")
    return per.groupBy(group).agg(total.alias("n_total"), n_ok.alias("n_ok"), F.when(total > 0, n_ok * 100.0 / total).alias("percent_ok"), as_map("_pre").alias("pre"), as_map("_post").alias("post"))


def trial_average(epochs: DataFrame, keys: list[str], array: str) -> DataFrame:
    """The mean over epochs at each time index: keys, time_idx, average, n_epochs."""
    return epochs.select(*keys, F.posexplode(array).alias("time_idx", "_x")).groupBy(*keys, "time_idx").agg(F.avg("_x").alias("average"), F.count("_x").alias("n_epochs"))


def longest_flat_run(samples: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Seconds of the longest run of equal consecutive values, missing ones left out first: its samples over fs; 0 for none."""
    w = Window.partitionBy(*keys).orderBy("sample_idx")
    d = samples.filter(F.col("value").isNotNull()).withColumn("_new", (F.col("value") != F.lag("value").over(w)).cast("int"))
    d = d.withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(w))
    runs = d.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*keys).agg(F.when(F.max("_n") > 1, F.max("_n") / fs).otherwise(F.lit(0.0)).alias("max_flat_seconds"))


def signal_validity(samples: DataFrame, keys: list[str], fs: float, *, least_finite: float = 0.95, most_flat: float = 2.0, most_z: float = 15.0, most_saturated: float = 0.01) -> DataFrame:
    """finite_fraction, max_flat_seconds, saturated_fraction (robust z over most_z) and flags of each signal:
    HIGH_NAN_RATIO, FLAT_SIGNAL (long runs, or fewer than two values), SATURATION. Flags only."""
    from neurolith.operators.signal import with_robust_z

    z = with_robust_z(samples, "value", "_z", tuple(keys))
    g = z.groupBy(*keys).agg((F.count("value") / F.count(F.lit(1))).alias("finite_fraction"), F.count("value").alias("_n"), F.coalesce(F.avg(F.when(F.col("value").isNotNull(), (F.abs("_z") > most_z).cast("double"))), F.lit(0.0)).alias("saturated_fraction"))
    g = g.join(longest_flat_run(samples, keys, fs), keys, "left").fillna({"max_flat_seconds": 0.0})
    flat = (F.col("max_flat_seconds") >= most_flat) | (F.col("_n") < 2)
    return g.withColumn("flags", distinct_reasons(F.when(F.col("finite_fraction") < least_finite, "HIGH_NAN_RATIO"), F.when(flat, "FLAT_SIGNAL"), F.when(F.col("saturated_fraction") > most_saturated, "SATURATION"))).drop("_n")


# --- phases ----------------------------------------------------------------------------------------------------------


def phase_segments(events: DataFrame, fs: float, *, exclusion: dict[str, float], otherwise: float, least_seconds: float) -> DataFrame:
    """events (..., phase, start_idx, stop_idx) -> two rows each: variant full, and stable, which starts exclusion[phase] seconds
    later. flag is DURATION_MISMATCH where a variant lasts less than least_seconds; none is dropped."""
    skip = F.lit(float(otherwise))
    for name, seconds in exclusion.items():
        skip = F.when(F.col("phase") == name, F.lit(float(seconds))).otherwise(skip)
    stable = F.least(F.col("stop_idx"), F.col("start_idx") + F.bround(skip * fs).cast("long"))
    both = F.array(F.struct(F.lit("full_phase").alias("variant"), F.col("start_idx").alias("from_idx")), F.struct(F.lit("stable_phase").alias("variant"), stable.alias("from_idx")))
    d = events.withColumn("_v", F.explode(both)).select(*[c for c in events.columns if c not in ("start_idx", "stop_idx")], "_v.variant", F.col("_v.from_idx").alias("start_idx"), "stop_idx")
    d = d.withColumn("duration_seconds", (F.col("stop_idx") - F.col("start_idx")) / fs)
    return d.withColumn("flag", F.when(F.col("duration_seconds") < least_seconds, "DURATION_MISMATCH"))


def event_checks(events: DataFrame, session: str, expected: list[str], *, n_samples: Column, duration: Column | None = None, most_offset: float = 1.0, fs: float = 1.0) -> DataFrame:
    """events (session, phase, start_idx, stop_idx) checked against the recording: bounds clipped, status and flags added.

    EVENT_OUT_OF_RANGE lies outside altogether; EVENT_CLIPPED in part; PHASE_OVERLAP begins before the furthest end so far;
    INVALID_EVENT_ORDER comes before a phase that should be earlier; a phase that is expected and absent gets a row of its
    own, without places, flagged MISSING_PHASE; DURATION_OFFSET says that the last end and duration are more than most_offset
    seconds apart. Rows stay, whatever their flags; status is ok, clipped or invalid.
    """
    w = Window.partitionBy(session).orderBy("start_idx", "stop_idx", "phase")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    a, b, rank = F.col("start_idx"), F.col("stop_idx"), rank_of(F.col("phase"), expected)
    d = events.withColumn("_n", n_samples).withColumn("_end", F.max("stop_idx").over(before)).withColumn("_rank", rank).withColumn("_most", F.max(rank).over(before))
    d = d.withColumn("_offset", (F.abs(F.max("stop_idx").over(Window.partitionBy(session)) / fs - duration) > most_offset) if duration is not None else F.lit(False))
    gone, cut = (b <= 0) | (a >= F.col("_n")), (a < 0) | (b > F.col("_n"))
    flags = distinct_reasons(F.when(gone, "EVENT_OUT_OF_RANGE"), F.when(cut, "EVENT_CLIPPED"), F.when(a < F.col("_end"), "PHASE_OVERLAP"), F.when(F.col("_rank") < F.col("_most"), "INVALID_EVENT_ORDER"), F.when(F.col("_offset"), "DURATION_OFFSET"))
    inside = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, F.col("_n")))
    d = d.withColumn("flags", flags).withColumn("status", F.when(gone, "invalid").when(cut, "clipped").otherwise("ok")).withColumn("start_idx", inside(a)).withColumn("stop_idx", inside(b))
    have = events.groupBy(session).agg(F.collect_set("phase").alias("_have"))
    absent = have.select(session, F.explode(F.array_except(F.array(*[F.lit(p) for p in expected]), F.col("_have"))).alias("phase"))
    missing = absent.select(session, "phase", F.lit("MISSING_PHASE").alias("flags"), F.lit("invalid").alias("status"))
    return d.drop("_n", "_end", "_rank", "_most", "_offset").unionByName(missing, allowMissingColumns=True)


def delta_features(samples: DataFrame, keys: list[str], baseline: DataFrame, baseline_keys: list[str]) -> DataFrame:
    """Of value and of value less its baseline, for each key: mean, median, least and largest, as *_absolute and *_delta."""
    d = samples.join(baseline.select(*baseline_keys, "baseline"), baseline_keys, "left").withColumn("_d", F.col("value") - F.col("baseline"))
    return d.groupBy(*keys).agg(*[f(c).alias(f"{n}_{kind}") for kind, c in (("absolute", "value"), ("delta", "_d")) for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))], (F.count("value") / F.count(F.lit(1))).alias("finite_fraction"))


def session_segments(events: DataFrame, session: str, *, window_phase: str = "MEDITATION", seconds: float = 120.0) -> DataFrame:
    """events (session, phase, start_s, stop_s) -> segments of each session: OVERALL, one for each event, and window_phase's
    windows of `seconds` as <phase>_WIN01, ..., the last one partial; none if the phase is shorter than one window."""
    from neurolith.operators.features import anchored_windows

    row = lambda d, name, a, b: d.select(session, name.alias("segment"), a.cast("double").alias("start_s"), b.cast("double").alias("stop_s"))
    whole = row(events.groupBy(session).agg(F.min("start_s").alias("a"), F.max("stop_s").alias("b")), F.lit("OVERALL"), F.col("a"), F.col("b"))
    each = row(events, F.col("phase"), F.col("start_s"), F.col("stop_s"))
    w = anchored_windows(events.filter(F.col("phase") == window_phase), seconds)
    windows = row(w, F.concat(F.lit(f"{window_phase}_WIN"), F.lpad((F.col("window") + 1).cast("string"), 2, "0")), F.col("from_s"), F.col("to_s"))
    return whole.unionByName(each).unionByName(windows)


def wide_metrics(rows: DataFrame, keys: list[str], parts: list[str], metrics: list[str], values: list[str]) -> DataFrame:
    """One row for each key with a column PART__...__metric for each of values (its parts joined by __)."""
    long = rows.unpivot([*keys, *parts], metrics, "_metric", "_value").withColumn("_name", F.concat_ws("__", *parts, "_metric"))
    return long.groupBy(*keys).pivot("_name", values).agg(F.first("_value", True))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows by name; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# --- personal tables --------------------------------------------------------------------------------------------------


def tier_summary(latest: DataFrame, trend: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Participants that all three tiers have, with the columns of all."""
    return latest.join(trend, key).join(reference, key)


def eligible_trend(trend: DataFrame, rows: DataFrame, key: str, least_sessions: int = 5) -> DataFrame:
    """Adds n_sessions and eligible (at least least_sessions) to a participant's trend, and rho null where it is not."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_sessions"))
    d = n.join(trend, key, "left").withColumn("eligible", F.col("n_sessions") >= least_sessions)
    return d.withColumn("rho", F.when(F.col("eligible"), F.col("rho")))


def spearman_p(rho: Column, n: Column) -> Column:
    """The two-sided p value of a rank correlation by Student's t with n - 2 degrees of freedom; null under 3 pairs."""

    @F.pandas_udf("double")
    def p(r: pd.Series, m: pd.Series) -> pd.Series:
        r, df = r.to_numpy(float), m.to_numpy(float) - 2
        fine = np.isfinite(r) & (df > 0)
        out = np.full(len(r), np.nan)
        out[fine] = incomplete_beta(df[fine] / 2, np.full(fine.sum(), 0.5), np.clip(1 - r[fine] ** 2, 0, 1))
        return pd.Series(out).astype("Float64").where(pd.Series(fine), None)

    return p(rho.cast("double"), n.cast("double"))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by a continued fraction from the side where it converges fast."""
    from math import lgamma

    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.array([lgamma(i + j) - lgamma(i) - lgamma(j) for i, j in zip(a, b, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def aligned_sign(rho: Column) -> Column:
    """+1 from a correlation of at least 0, else -1, also where there is none."""
    return F.when(rho >= 0, 1).otherwise(-1)


def presence(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Every key that any table has, with n_<name> rows of each table, and how many tables have it."""
    long = None
    for name, t in tables.items():
        one = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", F.lit(name))
        long = one if long is None else long.unionByName(one)
    g = long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_t") == n, F.col("_n"))), F.lit(0)).cast("long").alias(f"n_{n}") for n in tables], F.count(F.lit(1)).alias("n_modalities"))
    return g


def nested_series(samples: DataFrame, keys: list[str], series: str, bins: int) -> DataFrame:
    """One compact JSON object for each key: series name to its points (t, value) in order, at most `bins` means a series."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, series))
    b = samples.withColumn("_b", F.floor(F.col("sample_idx") / F.ceil(n / bins))).groupBy(*keys, series, "_b").agg(F.min("sample_idx").alias("t"), F.round(F.avg("value"), 3).alias("value"))
    each = b.groupBy(*keys, series).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_p"))
    return each.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(series, "_p"))))).alias("json"))
