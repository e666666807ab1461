"""Measures of raw signals that labels and session decisions are made of: filtered windows, beats, coupling, correlation, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import kernels as K
from neurolith.operators import signal as S
from neurolith.operators import spectra as P

KEYS = ["session_id", "signal"]
NEVER = float("inf")


def with_intervals(beats: DataFrame, fs: float, least: float = 0.4, most: float = 1.5) -> DataFrame:
    """beats (KEYS, peak_idx) with interval, the seconds since the beat before (null for the first), and whether it is valid."""
    gap = (F.col("peak_idx") - F.lag("peak_idx").over(Window.partitionBy(*KEYS).orderBy("peak_idx"))) / F.lit(float(fs))
    return beats.filter("peak_idx IS NOT NULL").select(*KEYS, "peak_idx").withColumn("interval", gap).withColumn("valid", F.col("interval").between(least, most))


def pulse_windows(filtered: DataFrame, beats: DataFrame, *, fs: float, size: int, setup_windows: int = 0, z: float = 6.0, rms_ratio: float = 12.0, ptp_ratio: float = 20.0) -> DataFrame:
    """The windows of `size` samples of filtered pulse signals (KEYS, sample_idx, value) with n_peaks, valid_ibi_percent,
    artifact and its reasons.

    A beat belongs to the window that it lies in, and so does the interval that ends with it, also one that began in the window
    before; a window of fewer than three beats has 0 % valid ones. Implausible are counts outside of what 35 to 200 beats a
    minute give, with one beat of grace on either side.
    """
    b = with_intervals(beats, fs).groupBy(*KEYS, F.floor(F.col("peak_idx") / size).alias("window_index")).agg(F.count(F.lit(1)).alias("n_peaks"), (F.avg(F.col("valid").cast("double")) * 100).alias("_valid"))
    w = S.window_table(filtered, size).select(*KEYS, "window_index", "rms", "ptp", "kurtosis", F.lit(0.0).alias("high_fraction")).join(b, [*KEYS, "window_index"], "left")
    w = w.withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0))).withColumn("valid_ibi_percent", F.when(F.col("n_peaks") >= 3, F.coalesce("_valid", F.lit(0.0))).otherwise(0.0)).drop("_valid")
    seconds = size / fs
    least, most = max(1, math.floor(seconds * 35 / 60 - 1)), math.ceil(seconds * 200 / 60 + 1)
    more = {"implausible_peak_count": ~F.col("n_peaks").between(least, most)}
    return S.flag_windows(w, z_rms=z, z_ptp=z, z_kurtosis=NEVER, rms_ratio=rms_ratio, ptp_ratio=ptp_ratio, high_fraction=NEVER, setup_windows=setup_windows, more=more).drop("high_fraction")


def optical_windows(samples: DataFrame, *, size: int, setup_windows: int = 0, z: float = 6.0, most_cv: float = 10.0) -> DataFrame:
    """Full windows of optical signals (KEYS, sample_idx, value raw, filtered): raw_mean, raw_cv_percent, rms and ptp of the
    filtered values, max_first_difference, their robust z, artifact and its reasons.

    Spread is that of the population over the mean's size (null for a mean of 0). The first difference is that of raw values
    with lines over what is missing: the step between two known neighbours over their distance.
    """
    window = F.floor(F.col("sample_idx") / size).alias("window_index")
    x, f = F.col("value"), F.col("filtered")
    known = samples.filter(x.isNotNull()).select(*KEYS, "sample_idx", "value", window)
    w = Window.partitionBy(*KEYS, "window_index").orderBy("sample_idx")
    step = F.abs(x - F.lag("value").over(w)) / (F.col("sample_idx") - F.lag("sample_idx").over(w))
    raw = known.withColumn("_s", step).groupBy(*KEYS, "window_index").agg(F.avg(x).alias("raw_mean"), F.stddev_pop(x).alias("_sd"), F.coalesce(F.max("_s"), F.lit(0.0)).alias("_step"))
    own = samples.groupBy(*KEYS, window).agg(F.sqrt(F.avg(f * f)).alias("rms"), (F.max(f) - F.min(f)).alias("ptp"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size).drop("_n")
    d = own.join(raw, [*KEYS, "window_index"], "left").withColumn("max_first_difference", F.coalesce("_step", F.lit(0.0)))
    d = d.withColumn("raw_cv_percent", F.col("_sd") / F.nullif(F.abs("raw_mean"), F.lit(0.0)) * 100).drop("_sd", "_step")
    for c, out in (("ptp", "z_ptp"), ("max_first_difference", "z_diff")):
        d = S.with_robust_z(d, c, out)
    fired = {"setup": F.col("window_index") < setup_windows, "high_peak_to_peak": F.col("z_ptp") > z, "motion_step": F.col("z_diff") > z, "high_local_cv": F.col("raw_cv_percent") > most_cv}
    d = d.withColumn("artifact_reason", F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in fired.items()]))
    return d.withColumn("artifact", F.col("artifact_reason") != "")


def pair_correlation(samples: DataFrame, a: str, b: str, value: str, out: str, least: int = 2) -> DataFrame:
    """(session_id, out): Pearson's correlation of two signals of a session over the places that both have; null for fewer than
    `least` of them, or where one has no spread."""
    at = lambda s: F.max(F.when(F.col("signal") == s, F.col(value)))
    both = samples.filter(F.col("signal").isin(a, b)).groupBy("session_id", "sample_idx").agg(at(a).alias("_a"), at(b).alias("_b")).dropna(subset=["_a", "_b"])
    fine = (F.count(F.lit(1)) >= least) & (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return both.groupBy("session_id").agg(F.when(fine, F.corr("_a", "_b")).alias(out))


def scalp_coupling(samples: DataFrame, *, fs: float, low: float = 0.8, high: float = 2.5, order: int = 3, a: str = "fNIRS_1", b: str = "fNIRS_2") -> DataFrame:
    """(session_id, coupling_index): the correlation of both wavelengths' raw signals in the band of the heart beat, near 1
    where both see the same pulse; null below four seconds."""
    d = K.own_step(samples.filter(F.col("signal").isin(a, b)), KEYS, lambda x: K.band_filter(x, fs, low, high, order))
    return pair_correlation(d, a, b, "changed", "coupling_index", least=math.ceil(4 * fs))


def pulse_measures(beats: DataFrame, *, fs: float) -> DataFrame:
    """(KEYS, n_peaks, valid_ibi_percent, median_hr_bpm, ibi_cv_percent, rmssd_ms) of whole series: 0 % valid, and nulls, where
    there are fewer than three beats or no valid interval. Successive differences are those of the valid intervals in turn."""
    d = with_intervals(beats, fs).withColumn("_v", F.when(F.col("valid"), F.col("interval")))
    known = F.last("_v", ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("peak_idx").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_d", F.col("_v") - known)
    some = (F.count(F.lit(1)) >= 3) & (F.count("_v") > 0)
    return d.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_peaks"), F.when(some, F.avg(F.col("valid").cast("double")) * 100).otherwise(0.0).alias("valid_ibi_percent"), F.when(some, F.median(60 / F.col("_v"))).alias("median_hr_bpm"),
        F.when(some, F.stddev_pop("_v") / F.avg("_v") * 100).alias("ibi_cv_percent"), F.when(some, F.sqrt(F.avg(F.col("_d") * F.col("_d"))) * 1000).alias("rmssd_ms"),
    )


def _percent(c: Column) -> Column:
    return F.avg(c.cast("double")) * 100


def session_windows(samples: DataFrame, *, eeg_fs: float, optical_fs: float, seconds: float, setup_seconds: float = 0.0, high: float = 150.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples (KEYS, sample_idx, value raw; null is missing) of AF3, AF4, PPG, fNIRS_1, fNIRS_2 -> the filtered samples (with
    raw and filtered), the pulse's beats, and the flagged windows of `seconds` of all signals, each filtered and judged by the
    rules of its modality: KEYS, window_index, rms, artifact, artifact_reason, high_amplitude."""
    kinds = {"eeg": ["AF3", "AF4"], "ppg": ["PPG"], "fnirs": ["fNIRS_1", "fNIRS_2"]}
    filtered, rate = None, {"eeg": eeg_fs, "ppg": optical_fs, "fnirs": optical_fs}
    for kind, names in kinds.items():
        own = K.own_step(samples.filter(F.col("signal").isin(*names)), KEYS, lambda x, k=kind: K.chain_filter(x, rate[k], k))
        filtered = own if filtered is None else filtered.unionByName(own)
    d = samples.select(*KEYS, "sample_idx", "value").join(filtered.withColumnRenamed("changed", "filtered"), [*KEYS, "sample_idx"])
    of = lambda kind: d.filter(F.col("signal").isin(*kinds[kind])).select(*KEYS, "sample_idx", F.col("filtered").alias("value"))
    size = {k: max(2, int(seconds * r)) for k, r in rate.items()}
    setup = int(math.ceil(setup_seconds / seconds))
    eeg = S.flag_windows(S.window_table(of("eeg"), size["eeg"], high), z_rms=6.0, z_ptp=6.0, z_kurtosis=8.0, rms_ratio=12.0, ptp_ratio=20.0, high_fraction=0.15, setup_windows=setup).withColumn("high_amplitude", F.col("high_fraction") > 0.15)
    beats = K.series_peaks(samples.filter("signal = 'PPG'"), KEYS, fs=optical_fs, chain="ppg", apart=0.35, prominent=True, least_seconds=0.0)
    pulse = pulse_windows(of("ppg"), beats, fs=optical_fs, size=size["ppg"], setup_windows=setup)
    optical = optical_windows(d.filter(F.col("signal").isin(*kinds["fnirs"])), size=size["fnirs"], setup_windows=setup)
    columns = [*KEYS, "window_index", "rms", "artifact", "artifact_reason"]
    windows = eeg.select(*columns, "high_amplitude")
    for w in (pulse, optical):
        windows = windows.unionByName(w.select(*columns), allowMissingColumns=True)
    return d, beats, windows


def signal_measures(samples: DataFrame, filtered: DataFrame, beats: DataFrame, windows: DataFrame, *, eeg_fs: float, optical_fs: float, floor_eeg: float = 2.0, floor_ppg: float = 1.0) -> DataFrame:
    """One row for each signal with modality and the measures that operators.session.signal_decisions looks at.

    Missing, clipped and flat samples, raw spread; the share of artifact windows (all of them where there is no window), of
    windows of high amplitude, and the 95th percentile of the windows' rms over its median (with a floor); of EEG the
    share of 1 to 4 Hz and the channels' correlation, both filtered; of PPG its beats; of the optical signals the coupling.
    """
    modality = F.when(F.col("signal").startswith("AF"), "EEG").when(F.col("signal") == "PPG", "PPG").otherwise("fNIRS")
    raw = samples.groupBy(*KEYS).agg((100.0 - F.count("value") * 100.0 / F.count(F.lit(1))).alias("missing_percent"), (F.stddev_pop("value") / F.nullif(F.abs(F.avg("value")), F.lit(0.0)) * 100).alias("raw_cv_percent"))
    rate = F.when(F.col("signal").startswith("AF"), eeg_fs).otherwise(optical_fs)
    flat = S.longest_flatline(samples, 1.0).select(*KEYS, (F.col("longest_flatline_seconds") / rate).alias("flatline_seconds"))
    floor = F.max(F.when(F.col("signal").startswith("AF"), floor_eeg).when(F.col("signal") == "PPG", floor_ppg).otherwise(1e-9))
    w = windows.groupBy(*KEYS).agg(_percent(F.col("artifact")).alias("artifact_percent"), _percent(F.col("high_amplitude")).alias("amplitude_bad_percent"), (F.percentile("rms", 0.95) / F.greatest(F.median("rms"), floor)).alias("dynamic_ratio"))
    eeg = filtered.filter(F.col("signal").startswith("AF")).select(*KEYS, "sample_idx", F.col("filtered").alias("value"))
    low = P.quality_ratios(P.power_density(eeg, KEYS, fs=eeg_fs, size=max(8, int(4 * eeg_fs))), KEYS, eeg_fs).select(*KEYS, "low_ratio")
    pair = pair_correlation(eeg, "AF3", "AF4", "value", "_pair")
    d = raw.join(S.clipping_percent(samples), KEYS).join(flat, KEYS).join(w, KEYS, "left").join(low, KEYS, "left").join(pulse_measures(beats, fs=optical_fs), KEYS, "left").join(pair, "session_id", "left").join(scalp_coupling(samples, fs=optical_fs), "session_id", "left")
    d = d.withColumn("modality", modality).withColumn("artifact_percent", F.coalesce("artifact_percent", F.lit(100.0)))
    only = lambda m, c: F.when(F.col("modality") == m, c)
    return d.withColumns({
        "amplitude_bad_percent": only("EEG", F.coalesce("amplitude_bad_percent", F.lit(0.0))), "good_percent": only("PPG", 100 - F.col("artifact_percent")),
        "valid_ibi_percent": only("PPG", F.coalesce("valid_ibi_percent", F.lit(0.0))), "channel_correlation": only("EEG", F.col("_pair")), "coupling_index": only("fNIRS", F.col("coupling_index")),
    }).drop("_pair")
