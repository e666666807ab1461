"""The optical chain of whole sessions: the time base, density, repair, filters, concentrations, detrending, phase metrics.

Repair and filters need a recording in order and take one Arrow call a session; what is pointwise or an aggregate is a
DataFrame expression. Keys are never null; sample_idx runs from 0 without holes within them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import kernels as K
from neurolith.operators import signal as S
from neurolith.operators import spectra as P
from neurolith.operators import tables as B


def time_checks(samples: DataFrame, keys: list[str], time: str, order: list[str], *, expected_fs: float, most_off: float = 1.0) -> DataFrame:
    """n_samples, sampling_rate_hz (1 over the median step forward) and input_qc_flags of each recording, in its own order:

    NON_MONOTONIC_TIME where a step is not forward, DUPLICATED_TIMESTAMP where one is 0, INVALID_SAMPLING_RATE where the rate
    is unknown or more than most_off from the expected one.
    """
    d = samples.withColumn("_dt", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(*order)))
    step = F.col("_dt")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), (1 / F.median(F.when(step > 0, step))).alias("sampling_rate_hz"), F.count_if(step <= 0).alias("_back"), F.count_if(step == 0).alias("_same"))
    off = F.coalesce(F.abs(F.col("sampling_rate_hz") - expected_fs) > most_off, F.lit(True))
    flags = F.concat_ws(";", F.when(F.col("_back") > 0, "NON_MONOTONIC_TIME"), F.when(F.col("_same") > 0, "DUPLICATED_TIMESTAMP"), F.when(off, "INVALID_SAMPLING_RATE"))
    return g.withColumn("input_qc_flags", flags).drop("_back", "_same")


def densities(optical: DataFrame, keys: list[str], i740: str = "i740", i850: str = "i850") -> DataFrame:
    """Add od740 and od850 against each recording's mean intensity, a partial aggregate joined back."""
    mean = optical.groupBy(*keys).agg(F.avg(i740).alias("_m740"), F.avg(i850).alias("_m850"))
    d = optical.join(mean, keys)
    return d.withColumns({"od740": X.optical_density(F.col(i740), F.col("_m740")), "od850": X.optical_density(F.col(i850), F.col("_m850"))}).drop("_m740", "_m850")


def cleaned_pair(rows: DataFrame, keys: list[str], a: str, b: str, *, fs: float, repair: bool, highpass: float | None, lowpass: float | None) -> DataFrame:
    """(keys, sample_idx, a, b, weight_a, weight_b, n): both series filled, repaired if asked for, and filtered.

    Gaps are filled by lines before a repair and by the median without one. The weights are those of the repair's steps, null
    at the first place; n is the recording's length.
    """
    kinds = dict(rows.dtypes)

    def clean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.isfinite(x)
        if repair:
            x, w = K.biweight_repair(K.filled(x), fs)
        else:
            x, w = np.where(ok, x, np.median(x[ok]) if ok.any() else 0.0), np.ones(max(len(x) - 1, 0))
        x = K.one_sided(x, fs, highpass, "high") if highpass else x
        x = K.one_sided(x, fs, lowpass, "low") if lowpass else x
        return x, np.concatenate([[np.nan], w])

    def run(key, part):
        part = part.sort_values("sample_idx", ignore_index=True)
        (x, wx), (y, wy) = clean(part[a].to_numpy(float)), clean(part[b].to_numpy(float))
        return part[[*keys, "sample_idx"]].assign(**{a: x, b: y, "weight_a": wx, "weight_b": wy, "n": len(part)})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", sample_idx long, {a} double, {b} double, weight_a double, weight_b double, n long"
    out = rows.select(*keys, "sample_idx", a, b).groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({w: F.nanvl(w, F.lit(None).cast("double")) for w in ("weight_a", "weight_b")})


def robust_lines(rows: DataFrame, keys: list[str], columns: list[str], *, bins: int = 2000, least: int = 10, place: str = "sample_idx", n: str = "n") -> DataFrame:
    """(keys, slope_<c>, height_<c>): the median slope of each column over the medians of at most `bins` bins, per sample.

    The bins are an aggregate; the pairs of the bins of one recording, never of its samples, are compared in one call.
    Recordings of fewer than `least` samples have a slope of 0 at the median. place runs from 0 to n - 1.
    """
    kinds = dict(rows.dtypes)
    binned = rows.groupBy(*keys, S.even_bin(F.col(place), F.col(n), bins).alias("_bin")).agg(F.median(place).alias("_x"), F.count(F.lit(1)).alias("_n"), *[F.median(c).alias(c) for c in columns])

    def line(key, part):
        out = dict(zip(keys, key, strict=True))
        for c in columns:
            ok = part[c].notna().to_numpy()
            x, y = part["_x"].to_numpy(float)[ok], part[c].to_numpy(float)[ok]
            few = part["_n"].sum() < least or len(x) < 2
            out[f"slope_{c}"], out[f"height_{c}"] = (0.0, float(np.median(y)) if len(y) else None) if few else K.median_slope(x, y)
        return pd.DataFrame([out])[[*keys, *[f"{p}_{c}" for c in columns for p in ("slope", "height")]]]

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{p}_{c} double" for c in columns for p in ("slope", "height")])
    return binned.groupBy(*keys).applyInPandas(line, schema)


def linear_detrended(rows: DataFrame, keys: list[str], columns: list[str], *, bins: int = 2000) -> DataFrame:
    """The columns without their robust line over the whole recording."""
    d = rows.join(robust_lines(rows, keys, columns, bins=bins), keys)
    trend = lambda c: F.col(f"slope_{c}") * F.col("sample_idx") + F.col(f"height_{c}")
    return d.withColumns({c: F.col(c) - trend(c) for c in columns}).drop(*[f"{p}_{c}" for c in columns for p in ("slope", "height")])


def rolling_detrended(rows: DataFrame, keys: list[str], columns: list[str], *, fs: float, seconds: float = 90.0) -> DataFrame:
    """The columns without their centred rolling median over `seconds` (an odd number of samples, three at least).

    Ends with fewer than a quarter of the window (three at least) take the nearest median; recordings shorter than the window
    lose their median. One call a recording, n log w in its length.
    """
    width = max(3, int(round(seconds * fs)))
    width += 1 - width % 2
    kinds = dict(rows.dtypes)

    def run(key, part):
        part = part.sort_values("sample_idx", ignore_index=True)
        for c in columns:
            x = part[c].astype(float)
            base = x.rolling(width, center=True, min_periods=max(3, width // 4)).median().bfill().ffill() if len(x) >= width else x.median()
            part[c] = x - base
        return part

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def preprocess(
    rows: DataFrame, keys: list[str], *, fs: float, stage: str = "intensity", repair: bool = True, highpass: float | None = None,
    lowpass: float | None = 0.2, detrend: str | None = "linear", bins: int = 2000, window_seconds: float = 90.0,
) -> DataFrame:
    """(keys, sample_idx, hbo, hbr, hbt, weight_a, weight_b) of whole recordings, before any phase is cut out.

    stage intensity takes i740 and i850: density, repair, concentrations, filters, detrending. The filters and the mix of both
    wavelengths are linear, so the densities are filtered in the call that repairs them and mixed afterwards. stage
    concentration takes hbo and hbr as they are. detrend is linear, rolling, or None; hbt is the sum of what comes out.
    """
    if stage not in ("intensity", "concentration") or detrend not in ("linear", "rolling", None):
        raise ValueError(f"stage {stage!r}, detrend {detrend!r}")
    pair = {"fs": fs, "repair": repair, "highpass": highpass, "lowpass": lowpass}
    if stage == "intensity":
        d = densities(rows, keys)
        mixed = lambda x: {k: v for k, v in X.concentrations(F.col("od740"), F.col("od850")).items() if k != "hbt"}
        if repair:
            d = cleaned_pair(d, keys, "od740", "od850", **pair)
            d = d.withColumns(mixed(d)).drop("od740", "od850")
        else:
            d = cleaned_pair(d.withColumns(mixed(d)), keys, "hbo", "hbr", **pair)
    else:
        d = cleaned_pair(rows, keys, "hbo", "hbr", **pair)
    if detrend == "linear":
        d = linear_detrended(d, keys, ["hbo", "hbr"], bins=bins)
    elif detrend == "rolling":
        d = rolling_detrended(d, keys, ["hbo", "hbr"], fs=fs, seconds=window_seconds)
    return d.withColumn("hbt", F.col("hbo") + F.col("hbr")).select(*keys, "sample_idx", "hbo", "hbr", "hbt", "weight_a", "weight_b")


def motion_fractions(cleaned: DataFrame, keys: list[str], most: float = 0.5) -> DataFrame:
    """The share of steps of each wavelength that the repair weighed below `most`, and the number of samples."""
    low = lambda w: F.avg((F.col(w) < most).cast("double"))
    return cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), low("weight_a").alias("motion_fraction_1"), low("weight_b").alias("motion_fraction_2"))


#: Features that shift with the baseline; all others of value and of value less its baseline are the same.
SHIFTED = ("mean", "median", "trimmed10", "min", "max")
SIGNALS = ("hbo", "hbr", "hbt")


def phase_metrics(session: DataFrame, segments: DataFrame, baseline: DataFrame, keys: list[str], *, fs: float, bins: int = 2000) -> DataFrame:
    """A row for each segment (keys, phase, variant, start_idx, stop_idx) and each of hbo, hbr and hbt: its robust features,
    the robust slope per minute (null under 4 values), what the baseline (keys, signal, baseline) moves as *_delta, and finite_fraction.

    Segments without samples have no rows here; segment_flags keeps them. Deltas are null without a baseline.
    """
    part = [*keys, "phase", "variant", "signal"]
    inside = B.in_segments(session.select(*keys, "sample_idx", *SIGNALS), segments.select(*keys, "phase", "variant", "start_idx", "stop_idx"), keys)
    long = inside.unpivot([*keys, "phase", "variant", "sample_idx", "start_idx", "stop_idx"], list(SIGNALS), "signal", "value")
    f = X.phase_features(long, part, fs)
    whole = long.groupBy(*part).agg((F.count("value") / F.count(F.lit(1))).alias("finite_fraction"), F.count("value").alias("_valid"))
    placed = long.withColumn("place", F.col("sample_idx") - F.col("start_idx")).withColumn("n", F.col("stop_idx") - F.col("start_idx"))
    lines = robust_lines(placed, part, ["value"], bins=bins, least=4, place="place").select(*part, (F.col("slope_value") * fs * 60).alias("robust_slope_per_min"))
    d = whole.join(f, part, "left").join(lines, part, "left").join(baseline.select(*keys, "signal", "baseline"), [*keys, "signal"], "left")
    deltas = {f"{m}_delta": F.col(m) - F.col("baseline") for m in SHIFTED}
    deltas["robust_slope_per_min"] = F.when(F.col("_valid") >= 4, F.col("robust_slope_per_min"))
    deltas["auc_delta"] = F.col("auc") - F.col("baseline") * (F.col("_valid") - 1) / fs
    return d.withColumns(deltas).drop("_valid")


def segment_flags(session: DataFrame, segments: DataFrame, baseline: DataFrame, keys: list[str], *, most_residual: float = 1e-6) -> DataFrame:
    """Every segment with hbt_residual, the greatest difference of hbt from hbo + hbr in it, and its qc_flags: the segment's
    own flag, DURATION_MISMATCH where it has no samples, HBT_INCONSISTENT, MISSING_BASELINE. None is dropped."""
    part = [*keys, "phase", "variant"]
    inside = B.in_segments(session.select(*keys, "sample_idx", *SIGNALS), segments.select(*part, "start_idx", "stop_idx"), keys)
    worst = inside.groupBy(*part).agg(F.max(F.abs(F.col("hbt") - (F.col("hbo") + F.col("hbr")))).alias("hbt_residual"), F.lit(True).alias("_some"))
    known = baseline.filter("baseline IS NOT NULL").select(*keys).distinct().withColumn("_based", F.lit(True))
    d = segments.join(worst, part, "left").join(known, keys, "left")
    some = F.col("_some").isNotNull()
    flags = B.distinct_reasons(F.col("flag"), F.when(~some, "DURATION_MISMATCH"), F.when(F.col("hbt_residual") > most_residual, "HBT_INCONSISTENT"), F.when(some & F.col("_based").isNull(), "MISSING_BASELINE"))
    return d.withColumn("qc_flags", flags).drop("_some", "_based", "flag")


def segment_low_ratio(session: DataFrame, segments: DataFrame, keys: list[str], *, fs: float, seconds: float, step_seconds: float, low: tuple[float, float], total: tuple[float, float]) -> DataFrame:
    """The low-frequency share of hbo in each segment, as the median over its windows."""
    inside = B.in_segments(session.select(*keys, "sample_idx", F.col("hbo").alias("value")), segments.select(*keys, "phase", "variant", "start_idx", "stop_idx"), keys)
    d = inside.withColumn("sample_idx", F.col("sample_idx") - F.col("start_idx"))
    return P.windowed_low_ratio(d, [*keys, "phase", "variant"], fs=fs, size=int(seconds * fs), step=int(step_seconds * fs), low=low, total=total)


def ratio_series(epochs: DataFrame, session: str, above: Column, below: Column, *, rest: str = "REST_BEFORE", least: int = 3) -> DataFrame:
    """epochs (session, epoch, phase, channel, ...): per epoch the mean of `above` over channels by that of `below`, with the
    session's baseline: the median ratio of its `rest` epochs, null with fewer than `least` of them."""
    g = epochs.groupBy(session, "epoch", "phase").agg(F.avg(above).alias("_a"), F.avg(below).alias("_b"))
    g = g.withColumn("ratio", F.when(F.col("_b") > 0, F.col("_a") / F.col("_b"))).drop("_a", "_b")
    calm = F.when(F.col("phase") == rest, F.col("ratio"))
    base = g.groupBy(session).agg(F.when(F.count(calm) >= least, F.median(calm)).alias("baseline"))
    return g.join(base, session)
