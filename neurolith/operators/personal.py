"""Series and fields of the personal report: bands and onsets by session, pooled composites, renamed fields, joins that keep both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import signal as S
from neurolith.operators import spectra as P
from neurolith.operators.features import PHASES

MICRO_SQUARED = 1e12


def _phase_rank(phase: str = "phase"):
    rank = F.lit(99)
    for i, p in enumerate(PHASES):
        rank = F.when(F.col(phase) == p, i).otherwise(rank)
    return rank


def band_series(epochs: DataFrame, session: str, bands: list[str], *, most: int = 60, channels: tuple[str, ...] = ("AF3", "AF4")) -> DataFrame:
    """epochs (session, phase, epoch, {channel}_{band} in V^2) -> (session, bin, n_epochs, phase_bound, each band in uV^2).

    Epochs go by phase (the known ones in their order, then others), then by number, into at most `most` bins of equal width,
    the last one shorter; a bin has the mean over its epochs of the mean over the channels that have a value, to three places,
    and the mean rank of its phases (-1 for others).
    """
    place = F.row_number().over(Window.partitionBy(session).orderBy("_rank", "epoch")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(session))
    d = epochs.withColumn("_rank", _phase_rank()).withColumns({"_place": place, "_n": n})
    values = {b: F.array_compact(F.array(*[F.col(f"{c}_{b}") for c in channels])) for b in bands}
    mean = {b: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)) for b, v in values.items()}
    d = d.withColumn("bin", F.floor(F.col("_place") / F.ceil(F.col("_n") / most))).withColumns({f"_{b}": m * MICRO_SQUARED for b, m in mean.items()})
    bound = F.avg(F.when(F.col("_rank") == 99, -1).otherwise(F.col("_rank")).cast("double"))
    return d.groupBy(session, "bin").agg(F.max("_n").alias("n_epochs"), bound.alias("phase_bound"), *[F.round(F.avg(f"_{b}"), 3).alias(b) for b in bands])


def onset_series(epochs: DataFrame, onsets: DataFrame, session: str, value: str, *, epoch_seconds: float = 2.0) -> DataFrame:
    """epochs (session, epoch, value) of one phase, onsets (session, threshold, latency, reached) -> (session, place, t, smoothed,
    threshold, latency, reached): each kept epoch's time since the first and its mean of three (zeros beyond the ends), at
    full resolution; sessions without a row of onsets keep nulls."""
    w = Window.partitionBy(session).orderBy("epoch")
    near = lambda f: F.coalesce(f(value).over(w), F.lit(0.0))
    d = epochs.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("smoothed", (near(F.lag) + F.col(value) + near(F.lead)) / 3)
    d = d.select(session, "place", F.round(F.col("place") * epoch_seconds, 1).alias("t"), F.round("smoothed", 5).alias("smoothed"))
    return d.join(onsets.select(session, F.round("threshold", 5).alias("threshold"), "latency", "reached"), session, "left")


def relaxation_onset(samples: DataFrame, baseline: DataFrame, *, sustain: int = 3, epoch_seconds: float = 2.0, smooth: int = 3) -> DataFrame:
    """S.sustained_onset with the rule that a phase of fewer than smooth + sustain epochs has no onset, and with duration_seconds
    and onset_percent, the share of the phase that had passed."""
    d = S.sustained_onset(samples, baseline, sustain, epoch_seconds)
    enough = F.col("n_epochs") >= smooth + sustain
    d = d.withColumns({"onset_idx": F.when(enough, F.col("onset_idx")), "onset_seconds": F.when(enough, F.col("onset_seconds")), "onset_reached": F.col("onset_reached") & enough})
    d = d.withColumn("duration_seconds", F.col("n_epochs") * epoch_seconds)
    return d.withColumn("onset_percent", F.col("onset_seconds") * 100 / F.nullif("duration_seconds", F.lit(0.0)))


def joined_with_suffixes(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_l1", "_l2")) -> DataFrame:
    """The left join on keys; other columns that both sides have get the side's suffix, so that none is lost."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    named = lambda d, s: d.select(*[F.col(c).alias(c + s) if c in both else F.col(c) for c in d.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), keys, "left")


def pooled_composite(rows: DataFrame, features: list[str], phases: list[str], signs: dict[str, int], *, least: int = 4, form: str = "{feature}__{phase}") -> DataFrame:
    """Add composite__{phase} for each phase: the mean over features of signed z scores, to three places; null with fewer than
    `least` of them.

    A feature's mean and population deviation are those of all its phases' values together, of all rows: one aggregate of
    sums, whose single row is joined by broadcast.
    """
    cell = lambda f, p: F.col(form.format(feature=f, phase=p))
    long = F.explode(F.array(*[F.array(*[cell(f, p) for f in features]) for p in phases])).alias("_v")
    stats = rows.select(long).agg(*[g(F.col("_v")[i]).alias(f"_{n}{i}") for i in range(len(features)) for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    d = rows.crossJoin(F.broadcast(stats))  # one row on the right
    out = {}
    for p in phases:
        z = F.array_compact(F.array(*[F.when(F.col(f"_s{i}") > 0, signs.get(f, 1) * (cell(f, p) - F.col(f"_m{i}")) / F.col(f"_s{i}")) for i, f in enumerate(features)]))
        out[f"composite__{p}"] = F.when(F.size(z) >= least, F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / F.size(z), 3))
    return d.withColumns(out).select(*rows.columns, *out)


def renamed_fields(rows: DataFrame, keys: list[str], fields: dict[str, tuple[str, int]]) -> DataFrame:
    """keys and, for each field (name: column and decimals), the rounded column; null where the table has no such column."""
    return rows.select(*keys, *[F.round(F.col(c), n).alias(name) if c in rows.columns else F.lit(None).cast("double").alias(name) for name, (c, n) in fields.items()])


def session_folders(sessions: DataFrame, root: str, *, participant: str = "participant_key", day: str = "study_day", session: str = "session_id") -> DataFrame:
    """(participant, day, session, folder): where each session's files lie, days with two digits; of several sessions of a day
    the first by id."""
    first = sessions.groupBy(participant, day).agg(F.min(session).alias(session))
    folder = F.concat(F.lit(root.rstrip("/") + "/participant="), F.col(participant).cast("string"), F.lit("/study_day="), F.lpad(F.col(day).cast("string"), 2, "0"), F.lit("/session_id="), F.col(session).cast("string"))
    return first.withColumn("folder", folder)


def band_power_retained(d: DataFrame, session: str, channel: str, *, fs: float, seconds: float = 4.0) -> DataFrame:
    """d (session, channel, sample_idx, pre, post) -> for each session and band of 1 to 45 Hz {band}_power_before, _after (means
    over channels) and _retained_pct (null where there was none)."""
    keys, size = [session, channel], max(8, int(seconds * fs))
    names = [b for b in P.BANDS if b != "high_beta"]
    out = None
    for column, when in (("pre", "before"), ("post", "after")):
        p = P.band_powers(P.power_density(d, keys, fs=fs, size=size, value=column), keys)
        p = p.groupBy(session).agg(*[F.avg(b).alias(f"{b}_power_{when}") for b in names])
        out = p if out is None else out.join(p, session, "full")
    return out.withColumns({f"{b}_power_retained_pct": F.when(F.col(f"{b}_power_before") > 0, 100 * F.col(f"{b}_power_after") / F.col(f"{b}_power_before")) for b in names})
