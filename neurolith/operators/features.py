"""Phase features, optical density and haemoglobin, heart and breath intervals, epochs of two channels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- optical ---------------------------------------------------------------------------------------------------------

#: Extinction coefficients (HbO, HbR) in 1/(mM cm) at 740 and 850 nm, source distance in cm, age.
EXTINCTION = ((0.446, 1.11588), (1.058, 0.69132))
DISTANCE_CM, AGE = 3.0, 28.0


def path_factor(wavelength: float, age: float = AGE) -> float:
    """The differential path length factor of a wavelength in nm at an age."""
    return 223.3 + 0.05624 * age**0.8493 - 5.723e-7 * wavelength**3 + 0.001245 * wavelength**2 - 0.9025 * wavelength


def optical_density(intensity: Column, reference: Column) -> Column:
    """Null where the intensity or the reference is: greatest() alone would take the floor for a missing one."""
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(1e-6)))
    return F.lit(0.0) - F.log10(floor(intensity) / floor(reference))


def concentrations(od_740: Column, od_850: Column) -> dict[str, Column]:
    """Changes of HbO, HbR and their sum in micromolar from optical densities: a constant 2 x 2 inverse."""
    (a, b), (c, d) = EXTINCTION
    det = a * d - b * c
    x, y = od_740 / (DISTANCE_CM * path_factor(740.0)), od_850 / (DISTANCE_CM * path_factor(850.0))
    hbo, hbr = (d / det * x - b / det * y) * 1000, (a / det * y - c / det * x) * 1000
    return {"hbo": hbo, "hbr": hbr, "hbt": hbo + hbr}


def haemoglobin(rows: DataFrame, keys: list[str], order: list[str], i740: str, i850: str, baseline_rows: int | None = None) -> DataFrame:
    """Add hbo, hbr, hbt; the reference is the mean of the first baseline_rows of each key, or of all."""
    whole = Window.partitionBy(*keys)
    d = rows.withColumn("_n", F.row_number().over(whole.orderBy(*order)))
    ref = lambda c: F.avg(F.when(F.col("_n") <= baseline_rows, F.col(c)) if baseline_rows else F.col(c)).over(whole)
    return d.withColumns(concentrations(optical_density(F.col(i740), ref(i740)), optical_density(F.col(i850), ref(i850)))).drop("_n")


# --- phases ----------------------------------------------------------------------------------------------------------

PHASES = ("REST_BEFORE", "MEDITATION", "REST_AFTER")


def phase_features(samples: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """mean, median, sd, mad, iqr, ptp, min, max, trimmed10, slope per minute, auc and valid_seconds of value for each key.

    The median, the rank and the neighbour need the group's order: one shuffle, two windows on the same key.
    """
    w = Window.partitionBy(*keys)
    t = F.col("sample_idx") / (fs * 60)
    d = samples.filter("value IS NOT NULL").withColumn("_m", F.median("value").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    d = d.withColumn("_r", F.row_number().over(w.orderBy("value", "sample_idx"))).withColumn("_prev", F.lag("value").over(w.orderBy("sample_idx")))
    cut = F.floor(F.col("_n") * 0.1)
    x = F.col("value")
    return d.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("sd"), (1.4826 * F.median(F.abs(x - F.col("_m")))).alias("mad"),
        (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"), (F.max(x) - F.min(x)).alias("ptp"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(F.when((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut), x)).alias("trimmed10"),
        F.regr_slope(x, t).alias("slope_per_min"), (F.sum((x + F.col("_prev")) / 2) / fs).alias("auc"), (F.count(x) / fs).alias("valid_seconds"),
    )


def phase_changes(features: DataFrame, keys: list[str], metrics: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Long: phase_from, phase_to, metric, value_from, value_to, change. Phases meet in one aggregate, not in a self-join."""
    long = features.unpivot([*keys, "phase"], metrics, "metric", "value")
    at = long.groupBy(*keys, "metric").agg(*[F.first(F.when(F.col("phase") == p, F.col("value")), True).alias(f"_{p}") for p in PHASES])
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("phase_from"), F.lit(b).alias("phase_to"), F.col(f"_{a}").alias("value_from"), F.col(f"_{b}").alias("value_to")) for a, b in pairs]))
    out = at.select(*keys, "metric", pair.alias("p")).select(*keys, "p.phase_from", "p.phase_to", "metric", "p.value_from", "p.value_to")
    return out.filter("value_from IS NOT NULL AND value_to IS NOT NULL").withColumn("change", F.col("value_to") - F.col("value_from"))


def phase_baseline(samples: DataFrame, phase: str, *, last: int, least: int, most_ratio: float) -> DataFrame:
    """The median of a phase's last samples per session and signal, for phases of at least `least` samples, and whether
    they spread more than most_ratio times the whole signal's scaled MAD."""
    keys = ["session_id", "signal"]
    w = Window.partitionBy(*keys)
    own = samples.filter(F.col("phase") == phase).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_ahead", F.row_number().over(w.orderBy(F.col("sample_idx").desc())) - 1)
    own = own.filter((F.col("_ahead") < last) & (F.col("_n") >= least)).groupBy(*keys).agg(F.median("value").alias("baseline"), F.stddev_pop("value").alias("_sd"))
    mad = samples.withColumn("_m", F.median("value").over(w)).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("value") - F.col("_m")))).alias("_mad"))
    return own.join(mad, keys).select(*keys, "baseline", (F.col("_sd") > most_ratio * F.col("_mad")).alias("baseline_high_variability"))


def align_events(events: DataFrame, n_samples: int) -> DataFrame:
    """events (session_id, event_order, start_idx, stop_idx, phase_rank) within [0, n_samples], with flags; none is dropped."""
    w = Window.partitionBy("session_id").orderBy("event_order")
    a, b = F.col("start_idx"), F.col("stop_idx")
    d = events.withColumn("_p", F.lag("stop_idx").over(w)).withColumn("_r", F.lag("phase_rank").over(w))
    flags = F.concat_ws(";", F.when((a < 0) | (b > n_samples), "EVENT_CLIPPED"), F.when((b <= 0) | (a >= n_samples), "EVENT_OUT_OF_RANGE"), F.when(a < F.col("_p"), "EVENT_OVERLAP"), F.when(F.col("phase_rank") < F.col("_r"), "EVENT_ORDER"))
    inside = lambda c: F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(n_samples).cast("long"))
    return d.withColumn("flags", flags).withColumn("start_idx", inside(a)).withColumn("stop_idx", inside(b)).drop("_p", "_r")


def thirds(segments: DataFrame, start: str, stop: str, least: float = 0.0) -> DataFrame:
    """Split [start, stop) into three by rounded cuts: part (0 to 2), part_start, part_stop. Shorter ones than least have none."""
    segments = segments.filter(F.col(stop) - F.col(start) >= least) if least else segments
    cut = lambda k: F.col(start) + F.bround((F.col(stop) - F.col(start)) * k / 3).cast("long")
    return segments.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), cut(k).alias("part_start"), cut(k + 1).alias("part_stop")) for k in range(3)]))).select("*", "_p.*").drop("_p")


def outlier_flags(rows: DataFrame, keys: list[str], metrics: list[str], most: float) -> DataFrame:
    """Add max_abs_robust_z over metrics within keys, and robust_outlier. Flags, never drops.

    Medians and deviations are aggregates with partial counts, joined back by the keys (nulls are a group), so a few large
    groups are not sorted in a few tasks. Without a deviation the standard one stands in, and 0 without that.
    """
    same = lambda t: [F.col(k).eqNullSafe(t[f"_k_{k}"]) for k in keys]
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    mid = rows.groupBy(*named).agg(*[F.median(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_sd_{m}") for m in metrics])
    d = rows.join(mid, same(mid))
    mad = d.groupBy(*named).agg(*[F.median(F.abs(F.col(m) - F.col(f"_m_{m}"))).alias(f"_mad_{m}") for m in metrics])
    d = d.drop(*[f"_k_{k}" for k in keys]).join(mad, same(mad))

    def z(m: str) -> Column:
        x = F.abs(F.col(m) - F.col(f"_m_{m}"))
        return F.coalesce(F.when(F.col(f"_mad_{m}") > 0, 0.67448975 * x / F.col(f"_mad_{m}")).when(F.col(f"_sd_{m}") > 0, x / F.col(f"_sd_{m}")), F.lit(0.0))

    worst = F.greatest(*[z(m) for m in metrics], F.lit(0.0))
    return d.withColumn("max_abs_robust_z", worst).withColumn("robust_outlier", F.col("max_abs_robust_z") > most).select(*rows.columns, "max_abs_robust_z", "robust_outlier")


#: Flags that only describe statistics and do not fail a row.
STAT_FLAGS = ("STATISTICAL_OUTLIER",)


def roll_up_flags(rows: DataFrame, flags: str) -> DataFrame:
    """`;`-joined flags: sorted and distinct, how many, and whether any but the statistical ones is set."""
    set_ = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(flags), F.lit("")), ";"), lambda x: x != "")))
    return rows.withColumn("_f", set_).withColumn(flags, F.array_join("_f", ";")).withColumn("n_flags", F.size("_f")).withColumn("qc_pass", F.size(F.array_except("_f", F.array(*[F.lit(x) for x in STAT_FLAGS]))) == 0).drop("_f")


def label_epochs(epochs: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """epochs (start, stop) get the description of the annotation (onset, duration > 0, description) that overlaps them
    longest, the first onset of ties; UNLABELED without one. The join is on the keys and the overlap."""
    a = annotations.filter("duration > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "onset", "duration", "description")
    end = F.col("onset") + F.col("duration")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [(F.col("onset") < F.col("stop")) & (end > F.col("start"))]
    j = epochs.join(a, on, "left").withColumn("_o", F.least(end, F.col("stop")) - F.greatest("onset", "start"))
    g = j.groupBy(*epochs.columns).agg(F.max_by("description", F.struct("_o", -F.col("onset"))).alias("phase"))
    return g.withColumn("phase", F.coalesce("phase", F.lit("UNLABELED")))


# --- intervals of beats and breaths ------------------------------------------------------------------------------------


def intervals(beats: DataFrame, key: str | list[str], at: str, scale: float, low: float, high: float) -> DataFrame:
    """(key, at, ibi): the time from the beat before, where it is within [low, high]. key is a column or a list of them."""
    keys = [key] if isinstance(key, str) else key
    gap = (F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))) * scale
    return beats.withColumn("ibi", gap).filter(F.col("ibi").between(low, high)).select(*keys, at, "ibi")


def hrv(ibi: DataFrame, key: str | list[str], at: str) -> DataFrame:
    """heart rate, RMSSD, SDRR, pRR50 and pRR20 in ms and percent; null with fewer than two intervals."""
    keys = [key] if isinstance(key, str) else key
    d = ibi.withColumn("_d", (F.col("ibi") - F.lag("ibi").over(Window.partitionBy(*keys).orderBy(at))) * 1000)
    n = F.count("ibi")
    g = d.groupBy(*keys).agg(n.alias("n_ibi"), F.when(n > 1, 60 / F.avg("ibi")).alias("hr_bpm"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd_ms"), (F.stddev_samp("ibi") * 1000).alias("sdrr_ms"), (F.avg((F.abs("_d") > 50).cast("double")) * 100).alias("prr50"), (F.avg((F.abs("_d") > 20).cast("double")) * 100).alias("prr20"), F.sum("ibi").alias("seconds"))
    return g.withColumn("quality_flag", F.when(F.col("hr_bpm").isNull(), "NO_VALID_IBI").when(F.col("seconds") < 30, "SHORT_SEGMENT").when(F.col("n_ibi") < 10, "LOW_BEAT_COUNT").otherwise("OK"))


def breathing(bbi: DataFrame, key: str | list[str]) -> DataFrame:
    """Breaths a minute, their variation in percent, and a flag."""
    g = bbi.groupBy(*([key] if isinstance(key, str) else key)).agg(F.count("ibi").alias("n_bbi"), (60 / F.avg("ibi")).alias("resp_rate"), (F.stddev_samp("ibi") / F.avg("ibi") * 100).alias("resp_cv"), F.sum("ibi").alias("seconds"))
    return g.withColumn("quality_flag", F.when(F.col("resp_rate").isNull(), "NO_VALID_BREATHS").when(F.col("seconds") < 30, "SHORT_SEGMENT").when(F.col("n_bbi") < 3, "LOW_BREATH_COUNT").otherwise("OK"))


def anchored_windows(segments: DataFrame, seconds: float) -> DataFrame:
    """Windows of `seconds` from each segment's start (start_s, stop_s); the last is partial; none if it is shorter."""
    n = F.ceil((F.col("stop_s") - F.col("start_s")) / seconds)
    d = segments.filter((F.col("stop_s") - F.col("start_s")) >= seconds).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.withColumn("from_s", F.col("start_s") + F.col("window") * seconds).withColumn("to_s", F.least(F.col("from_s") + seconds, F.col("stop_s")))


def sliding_windows(samples: DataFrame, keys: list[str], size: int, step: int, least_finite: float | None = None) -> DataFrame:
    """mean and n of each full window of `size` samples every `step`: samples are spread to their windows, then summed. With
    least_finite, n_finite too, and only windows in which that share of the samples is a number."""
    last = F.floor(F.col("sample_idx") / step)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("sample_idx") - size) / step) + 1)
    d = samples.withColumn("window", F.explode(F.sequence(first, last)))
    if least_finite is None:
        g = d.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        return g.filter(F.col("n") == size)
    fine = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    g = d.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.count(fine).alias("n_finite"), F.avg(fine).alias("mean"))
    return g.filter((F.col("n") == size) & (F.col("n_finite") >= least_finite * size))


# --- epochs as arrays ------------------------------------------------------------------------------------------------

BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def variance(a: Column) -> Column:
    return _mean(F.transform(a, lambda x: x * x)) - _mean(a) * _mean(a)


def diff(a: Column) -> Column:
    return F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1), lambda x, y: x - y)


def hjorth(a: Column) -> dict[str, Column]:
    """activity, mobility and complexity, array functions only."""
    v0, v1, v2 = variance(a), variance(diff(a)), variance(diff(diff(a)))
    mobility = F.sqrt(v1 / v0)
    return {"activity": v0, "mobility": mobility, "complexity": F.sqrt(v2 / v1) / mobility}


def dft_power(a: Column, n: int, k: int) -> Column:
    """Power of the k-th bin of the discrete Fourier transform of n values: two sums with constant arrays."""
    parts = [F.array(*[F.lit(f(2 * math.pi * k * i / n)) for i in range(n)]) for f in (math.cos, math.sin)]
    re, im = (_sum(F.zip_with(a, p, lambda x, y: x * y)) for p in parts)
    return (re * re + im * im) / n


def band_powers(a: Column, n: int) -> dict[str, Column]:
    """Absolute power of BANDS, closed at both ends, at n samples a second."""
    return {name: sum((dft_power(a, n, k) for k in range(lo, hi + 1)), F.lit(0.0)) for name, (lo, hi) in BANDS.items()}


def shannon_histogram(epochs: DataFrame, key: str, array: str, bins: int = 64) -> DataFrame:
    """Entropy in nats of the histogram of each epoch's values between its least and largest."""
    x = epochs.select(key, F.array_min(array).alias("_lo"), F.array_max(array).alias("_hi"), F.explode(array).alias("x"))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    n = x.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))
