"""Sample streams as tables: windows, gaps, runs, fills, and signal quality.

Samples are rows (session_id, signal, sample_idx, value, ...); each operator keys its windows by session and signal, so
sessions spread over the cluster and one shuffle on (session_id, signal) serves a chain of them. Nulls are missing samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("session_id", "signal")


def by(*keys: str, order: str | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(order) if order else w


def with_robust_z(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """0.67448975 * (x - median) / MAD within keys; by the standard deviation if the MAD is 0, and 0 if that is too."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_m", F.median(column).over(w))
    d = d.withColumn("_mad", F.median(F.abs(F.col(column) - F.col("_m"))).over(w)).withColumn("_sd", F.stddev_pop(column).over(w))
    x = F.col(column) - F.col("_m")
    z = F.when(F.col("_mad") > 0, 0.67448975 * x / F.col("_mad")).when(F.col("_sd") > 0, x / F.col("_sd")).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
    return d.withColumn(out, z).drop("_m", "_mad", "_sd")


def pearson_kurtosis(x: str) -> Column:
    """Bias-corrected, 3 for a normal distribution; null for fewer than 4 values or no spread."""
    n, g = F.count(x).cast("double"), F.kurtosis(x) + 3
    return F.when(n > 3, ((n * n - 1) * g - 3 * (n - 1) * (n - 1)) / ((n - 2) * (n - 3)) + 3)


def tumbling(samples: DataFrame, size: int) -> DataFrame:
    """Add window_index; a last, partial window is left out."""
    n = F.max("sample_idx").over(by(*KEYS)) + 1
    d = samples.withColumn("window_index", F.floor(F.col("sample_idx") / size)).withColumn("_n", n)
    return d.filter(F.col("sample_idx") < F.floor(F.col("_n") / size) * size).drop("_n")


def window_table(samples: DataFrame, size: int, high: float = 150.0) -> DataFrame:
    """One row per full window: rms, ptp, max_abs, high_fraction, kurtosis. A hash aggregate with partial sums."""
    w = samples.groupBy(*KEYS, F.floor(F.col("sample_idx") / size).alias("window_index"))
    x = F.col("value")
    w = w.agg(F.sqrt(F.avg(x * x)).alias("rms"), (F.max(x) - F.min(x)).alias("ptp"), F.max(F.abs(x)).alias("max_abs"), F.avg(F.when(F.abs(x) > high, 1.0).otherwise(0.0)).alias("high_fraction"), pearson_kurtosis("value").alias("kurtosis"), F.count(F.lit(1)).alias("_n"))
    return w.filter(F.col("_n") == size).drop("_n")


def flag_windows(windows: DataFrame, *, z_rms: float, z_ptp: float, z_kurtosis: float, rms_ratio: float, ptp_ratio: float, high_fraction: float, setup_windows: int = 0, more: dict[str, Column] | None = None) -> DataFrame:
    """Add robust z scores, ratios to the median, artifact and its reasons, `;` between them, in a fixed order, those of `more` (reason: when) last.
    Flags only."""
    d = windows
    for c in ("rms", "ptp", "kurtosis"):
        d = with_robust_z(d, c, f"z_{c}")
    for c in ("rms", "ptp"):
        d = d.withColumn(f"{c}_ratio", F.col(c) / F.greatest(F.median(c).over(by(*KEYS)), F.lit(1e-12)))
    fired = {
        "setup": F.col("window_index") < setup_windows,
        "high_rms": (F.col("z_rms") > z_rms) | (F.col("rms_ratio") > rms_ratio),
        "high_peak_to_peak": (F.col("z_ptp") > z_ptp) | (F.col("ptp_ratio") > ptp_ratio),
        "high_kurtosis": F.col("z_kurtosis") > z_kurtosis,
        "high_amplitude_uv": F.col("high_fraction") > high_fraction,
        **(more or {}),
    }
    d = d.withColumn("artifact_reason", F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in fired.items()]))
    return d.withColumn("artifact", F.col("artifact_reason") != "")


def signal_labels(flagged: DataFrame, severe: float, moderate: float, dynamic: float) -> DataFrame:
    """One row per signal: artifact_percent, dyn (95th percentile of rms over its median), label and reason."""
    s = flagged.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_windows"), (F.avg(F.col("artifact").cast("double")) * 100).alias("artifact_percent"), dynamic_ratio("rms", 0.95, 1e-9).alias("dyn"))
    fail, conditional = F.col("artifact_percent") > severe, (F.col("artifact_percent") > moderate) | (F.col("dyn") > dynamic)
    return s.withColumn("label", F.when(fail, "FAIL").when(conditional, "CONDITIONAL_PASS").otherwise("PASS")).withColumn("reason", F.when(fail, "severe_recurrent_artifact").when(conditional, "moderate_artifact_burden").otherwise("acceptable_qc_metrics"))


def dynamic_ratio(x: str, p: float, floor: float) -> Column:
    return F.percentile(x, p) / F.greatest(F.median(x), F.lit(floor))


def global_artifacts(flagged: DataFrame, least_signals: int = 3) -> DataFrame:
    """Add n_signals_artifact, the signals flagged in a window's place, and whether they are at least least_signals."""
    n = flagged.groupBy("session_id", "window_index").agg(F.count_distinct(F.when(F.col("artifact"), F.col("signal"))).alias("n_signals_artifact"))
    return flagged.join(n, ["session_id", "window_index"]).withColumn("global_multimodal_artifact", F.col("n_signals_artifact") >= least_signals)


def session_labels(signals: DataFrame, global_percent: DataFrame, most_global: float, some_global: float) -> DataFrame:
    """One row per session from its signals' labels: AF3 and AF4 are EEG, PPG, and fNIRS_1 and fNIRS_2; an absent one is
    NOT_ASSESSABLE and no pass. operators/session.py decides with the recording's packets and duration, too."""
    label = lambda s: F.max(F.when(F.col("signal") == s, F.col("label")))
    s = signals.groupBy("session_id").agg(*[label(x).alias(f"_{x}") for x in ("AF3", "AF4", "PPG", "fNIRS_1", "fNIRS_2")])
    some = lambda x, y, what: (F.col(x) == what) | (F.col(y) == what)
    gone = lambda x, y: F.col(x).isNull() | F.col(y).isNull()
    worst = lambda x, y: F.when(some(x, y, "FAIL"), "FAIL").when(gone(x, y), "NOT_ASSESSABLE").when(some(x, y, "CONDITIONAL_PASS"), "CONDITIONAL_PASS").otherwise("PASS")
    fnirs = F.when((F.col("_fNIRS_1") == "FAIL") & (F.col("_fNIRS_2") == "FAIL"), "FAIL").when((F.col("_fNIRS_1") == "PASS") & (F.col("_fNIRS_2") == "PASS"), "PASS").otherwise("CONDITIONAL_PASS")
    s = s.select("session_id", worst("_AF3", "_AF4").alias("eeg_label"), F.coalesce("_PPG", F.lit("NOT_ASSESSABLE")).alias("ppg_label"), fnirs.alias("fnirs_label")).join(global_percent, "session_id", "left")
    both = (F.col("eeg_label") == "FAIL") & (F.col("ppg_label") == "FAIL")
    severe = F.col("global_artifact_percent") > most_global
    partial = (F.col("eeg_label") != "PASS") | (F.col("ppg_label") != "PASS") | (F.col("fnirs_label") != "PASS") | (F.col("global_artifact_percent") > some_global)
    s = s.withColumn("overall_label", F.when(both | severe, "FAIL").when(partial, "CONDITIONAL_PASS").otherwise("PASS"))
    reason = F.when(both, "eeg_and_ppg_failed").when(severe, "severe_multimodal_artifact").when(partial, "usable_after_cleaning_or_partial_modality_limit").otherwise("all_primary_qc_layers_passed")
    status = F.when(F.col("overall_label") == "PASS", "included").when(F.col("overall_label") == "CONDITIONAL_PASS", "included_after_cleaning").otherwise("excluded_from_primary_analysis")
    return s.withColumn("reasons", reason).withColumn("analysis_status", status)


def islands(df: DataFrame, keys: tuple[str, ...], order: str, new: Column, out: str) -> DataFrame:
    """Add out, 0-based: how many rows up to this one start anew."""
    return df.withColumn(out, F.sum(F.when(new, 1).otherwise(0)).over(by(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def merge_intervals(flagged: DataFrame) -> DataFrame:
    """Flagged windows that touch become one interval: start and end window (exclusive), and all their reasons, sorted."""
    a = flagged.filter("artifact").select(*KEYS, "window_index", "artifact_reason")
    gap = F.col("window_index") > F.lag("window_index").over(by(*KEYS, order="window_index")) + 1
    a = islands(a, KEYS, "window_index", F.coalesce(gap, F.lit(False)), "interval")
    g = a.groupBy(*KEYS, "interval").agg(F.min("window_index").alias("start_window"), (F.max("window_index") + 1).alias("end_window"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("artifact_reason", ";"))))), ";").alias("reason"))
    return g.drop("interval")


def split_blocks(rows: DataFrame, keys: tuple[str, ...], ts: str, most_gap: Column | float) -> DataFrame:
    """Add block_id: a new block begins where ts is more than most_gap after the row before."""
    gap = F.col(ts) - F.lag(ts).over(by(*keys, order=ts))
    return islands(rows, keys, ts, F.coalesce(gap > most_gap, F.lit(False)), "block_id")


def longest_block(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The block with the most rows for each key, the first of ties: block_id, n_rows."""
    n = blocks.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.groupBy(*keys).agg(F.max_by("block_id", F.struct("n_rows", -F.col("block_id"))).alias("block_id"), F.max("n_rows").alias("n_rows"))


def longest_flatline(samples: DataFrame, fs: float, tolerance: float = 0.0) -> DataFrame:
    """Seconds of the longest run of samples that each differ from the one before by at most tolerance; 0 without any."""
    w = by(*KEYS, order="sample_idx")
    d = samples.withColumn("_same", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) <= tolerance, F.lit(False)))
    d = islands(d, KEYS, "sample_idx", ~F.col("_same"), "_run")
    runs = d.groupBy(*KEYS, "_run").agg(F.sum(F.col("_same").cast("long")).alias("_n"))
    longest = F.max("_n")
    return runs.groupBy(*KEYS).agg(F.when(longest > 0, (longest + 1) / fs).otherwise(F.lit(0.0)).alias("longest_flatline_seconds"))


def clipping_percent(samples: DataFrame) -> DataFrame:
    """Share of samples at the signal's least or largest value. Two aggregates, no window over samples."""
    n = samples.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("_n"))
    e = n.groupBy(*KEYS).agg(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))).alias("_all"), F.min_by("_n", "value").alias("_lo"), F.max_by("_n", "value").alias("_hi"), F.count_distinct("value").alias("_d"))
    return e.select(*KEYS, (F.when(F.col("_d") > 1, F.col("_lo") + F.col("_hi")).otherwise(F.col("_lo")) * 100.0 / F.col("_all")).alias("clipping_percent"))


def packet_stats(packets: DataFrame, key: str, ts: str, long_interval: float) -> DataFrame:
    """Count, median, least and largest interval, repeated time stamps and long intervals of each key."""
    d = packets.withColumn("_d", F.col(ts) - F.lag(ts).over(by(key, order=ts)))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_packets"), F.median("_d").alias("median_interval"), F.min("_d").alias("min_interval"), F.max("_d").alias("max_interval"), (F.count(ts) - F.count_distinct(ts)).alias("n_duplicates"), F.count_if(F.col("_d") > long_interval).alias("n_long_intervals"))


def overview_start(flagged: DataFrame, span: int) -> DataFrame:
    """The window with the least share of flagged signals (the first of ties) after which `span` windows still fit."""
    g = flagged.groupBy("session_id", "window_index").agg(F.avg(F.col("artifact").cast("double")).alias("_a"))
    g = g.withColumn("_n", F.max("window_index").over(by("session_id")) + 1).filter(F.col("window_index") + span <= F.col("_n"))
    return g.groupBy("session_id").agg(F.min_by("window_index", F.struct("_a", "window_index")).alias("start_window"))


def fill_linear(samples: DataFrame) -> DataFrame:
    """Add filled: gaps by the line between their neighbours, ends by the nearest value, 0 if all are missing.

    Both neighbours come from frames that only grow, one in either order, so the cost is in proportion to the samples.
    """
    known = F.when(F.col("value").isNotNull(), F.struct("sample_idx", "value"))
    nearest = lambda order: F.last(known, True).over(by(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = samples.withColumn("_p", nearest(F.col("sample_idx"))).withColumn("_q", nearest(F.col("sample_idx").desc()))
    line = F.col("_p.value") + (F.col("_q.value") - F.col("_p.value")) * (F.col("sample_idx") - F.col("_p.sample_idx")) / (F.col("_q.sample_idx") - F.col("_p.sample_idx"))
    return d.withColumn("filled", F.coalesce("value", line, F.col("_p.value"), F.col("_q.value"), F.lit(0.0))).drop("_p", "_q")


def fill_median(samples: DataFrame) -> DataFrame:
    return samples.withColumn("filled", F.coalesce("value", F.median("value").over(by(*KEYS))))


def adc_to_uv(counts: Column, bits: int = 24, vref: float = 2.4) -> Column:
    """Counts of an offset-binary converter as microvolts."""
    half = float(2 ** (bits - 1))
    return (counts - half) * 1e6 * vref / half / 2


def moving_mean(samples: DataFrame, value: str = "value") -> DataFrame:
    """Add smoothed: the mean of three with zeros beyond the ends."""
    w = by(*KEYS, order="sample_idx")
    return samples.withColumn("smoothed", (F.coalesce(F.lag(value).over(w), F.lit(0.0)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.lit(0.0))) / 3)


def rolling_median(samples: DataFrame, width: int) -> DataFrame:
    """Add rolling_median over width (odd) samples; places with fewer than max(3, width / 4) of them take the nearest median,
    the one before if there is one."""
    w = by(*KEYS, order="sample_idx").rowsBetween(-(width // 2), width // 2)
    d = samples.withColumn("rolling_median", F.when(F.count("value").over(w) >= max(3, width // 4), F.percentile("value", 0.5).over(w)))
    nearest = lambda order: F.last("rolling_median", True).over(by(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("rolling_median", F.coalesce("rolling_median", nearest(F.col("sample_idx")), nearest(F.col("sample_idx").desc())))


def downsample(samples: DataFrame, most: int) -> DataFrame:
    """At most `most` bins of equal width per signal: bin, value (mean), n."""
    n = F.count(F.lit(1)).over(by(*KEYS))
    d = samples.withColumn("bin", F.floor(F.col("sample_idx") / F.ceil(n / most)))
    return d.groupBy(*KEYS, "bin").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def even_bin(place: Column, n: Column, bins: int) -> Column:
    """Which of `bins` parts of nearly equal counts a place among n lies in: cuts at floor(k n / bins); fewer parts where n is less."""
    at = F.floor((place * bins + bins - 1) / n)
    return F.when(F.floor(at * n / bins) > place, at - 1).otherwise(at)


def even_bins(samples: DataFrame, bins: int) -> DataFrame:
    """Bins of nearly equal counts per signal: bin, its median and the median of its places."""
    d = samples.withColumn("_n", F.count(F.lit(1)).over(by(*KEYS)))
    d = d.withColumn("bin", even_bin(F.col("sample_idx"), F.col("_n"), bins))
    return d.groupBy(*KEYS, "bin").agg(F.median("value").alias("value"), F.median("sample_idx").alias("place"))


def sustained_onset(samples: DataFrame, baseline: DataFrame, sustain: int, epoch_seconds: float) -> DataFrame:
    """The first place from which `sustain` smoothed values in a row reach the baseline (session_id, signal, baseline)."""
    ahead = by(*KEYS, order="sample_idx").rowsBetween(0, sustain - 1)
    d = moving_mean(samples).join(baseline, list(KEYS))
    held = (F.min("smoothed").over(ahead) >= F.col("baseline")) & (F.count("smoothed").over(ahead) == sustain)
    d = d.withColumn("_at", F.when(held, F.col("sample_idx")))
    out = d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_epochs"), F.min("_at").alias("onset_idx"))
    return out.withColumn("onset_reached", F.col("onset_idx").isNotNull()).withColumn("onset_seconds", F.col("onset_idx") * epoch_seconds)


def longest_above(samples: DataFrame, baseline: DataFrame, times: float, epoch_seconds: float) -> DataFrame:
    """Share of smoothed values over times * baseline, and the longest run of them (the first of ties)."""
    d = moving_mean(samples).join(baseline, list(KEYS)).withColumn("_on", F.col("smoothed") > F.col("baseline") * times)
    d = islands(d, KEYS, "sample_idx", ~F.col("_on"), "_run")
    runs = d.groupBy(*KEYS, "_run").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_on").cast("long")).alias("_len"), F.min(F.when(F.col("_on"), F.col("sample_idx"))).alias("_start"))
    out = runs.groupBy(*KEYS).agg((F.sum("_len") * 100.0 / F.sum("_n")).alias("percent_above"), F.max("_len").alias("_best"), F.max_by("_start", F.struct("_len", -F.col("_start"))).alias("_start"))
    return out.select(*KEYS, "percent_above", F.when(F.col("_best") > 0, F.col("_start")).alias("longest_start"), (F.col("_best") * epoch_seconds).alias("longest_seconds"))


def epoch_gaps(kept: DataFrame, step: float, tolerance: float = 1.5) -> DataFrame:
    """Gaps between kept places that should be `step` apart: number of gaps, and epochs missing in them."""
    d = kept.withColumn("_d", F.col("sample_idx") - F.lag("sample_idx").over(by(*KEYS, order="sample_idx")))
    gap = F.col("_d") > step * tolerance
    return d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(gap).alias("n_gaps"), F.coalesce(F.sum(F.when(gap, F.bround(F.col("_d") / step) - 1)), F.lit(0.0)).cast("long").alias("n_missing"))
