"""Removal of heart beats from recordings: a template locked to the peaks of each epoch, taken out beat by beat.

Peaks come from a proxy of each epoch (one small call an epoch); template, fit and removal are joins and aggregates by epoch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.operators import kernels as K


def epoch_peaks(samples: DataFrame, session: str, channel: str, *, fs: float, epoch_seconds: float = 30.0, window_seconds: float = 0.5, lowpass: float = 100.0, peakiness: float = 2.0, heart_channels: list[str] | None = None) -> DataFrame:
    """(session, epoch, peak): the places of heart beats in epochs of epoch_seconds, at least window_seconds apart.

    The proxy is the mean size of heart_channels where there are any; else the mean square of all channels below `lowpass`, and
    then an epoch counts only if its peaks' median is at least `peakiness` times the median of all. Peaks within a window of
    an end of the epoch are left out; epochs of fewer than two peaks, or shorter than three windows, have none. A place where
    no channel has a value counts as 0. An epoch is one group, however long the recording.
    """
    size, win = int(epoch_seconds * fs), max(1, int(window_seconds * fs))
    d = samples.select(session, channel, "sample_idx", "value")
    d = d.filter(F.col(channel).isin(*heart_channels)) if heart_channels else d
    epoch = F.floor(F.col("sample_idx") / size)
    if not heart_channels:
        sections = K.butter_sections(4, [min(lowpass, 0.999 * fs / 2)], "low", fs)
        kinds = dict(d.dtypes)

        def slow(key, rows):
            rows = rows.sort_values("sample_idx", ignore_index=True)
            x = K.filled(rows.value.to_numpy(float))
            return rows.assign(value=K.filtfilt(sections, x) if len(x) >= 3 * win and len(x) > 1 else x).drop(columns="epoch")

        d = d.withColumn("epoch", epoch).groupBy(session, channel, "epoch").applyInPandas(slow, f"{session} {kinds[session]}, {channel} {kinds[channel]}, sample_idx long, value double")
    proxy = d.groupBy(session, "sample_idx").agg(F.avg(F.abs("value") if heart_channels else F.col("value") * F.col("value")).alias("p"))
    kind = dict(samples.dtypes)[session]

    def find(key, rows):
        rows = rows.sort_values("sample_idx")
        p, first = rows.p.fillna(0.0).to_numpy(float), int(key[1]) * size
        none = pd.DataFrame({session: pd.Series([], dtype=object), "epoch": [], "peak": []})
        at = rows.sample_idx.to_numpy(np.int64) - first
        if not len(p) or at[-1] + 1 < 3 * win:
            return none
        x = np.zeros(at[-1] + 1)
        x[at] = p
        found = K.peaks(x, win)
        found = found[(found >= win) & (found < len(x) - win)]
        if len(found) < 2 or (not heart_channels and np.median(x[found]) < peakiness * (np.median(x) + 1e-20)):
            return none
        return pd.DataFrame({session: key[0], "epoch": key[1], "peak": found + first})

    return proxy.groupBy(session, epoch.alias("epoch")).applyInPandas(find, f"{session} {kind}, epoch long, peak long")


def remove_beats(samples: DataFrame, peaks: DataFrame, session: str, channel: str, *, epoch: int, window: int) -> DataFrame:
    """samples (session, channel, sample_idx, value), peaks (session, epoch, peak) -> samples with `cleaned`.

    About each peak lie `window` samples before it and as many from it on. A channel's template in an epoch is the mean by lag
    over the epoch's peaks whose windows the channel has whole, of which there must be two. Beat after beat, the template
    fitted by least squares is taken from what the beats before left; where two windows overlap, the fit of a beat depends
    on the one before, by s_k = a_k - c_k s_(k-1): a is the fit to the samples, c that of the template to itself at the
    peaks' distance. Peaks are at least `window` apart, so no third one matters. Samples without peaks, and null values, stay
    as they are. Peaks given twice count once.
    """
    keys = [session, channel, "epoch"]
    d = samples.withColumn("epoch", F.floor(F.col("sample_idx") / epoch))
    p = peaks.select(session, "epoch", "peak").distinct()
    lag = F.explode(F.sequence(F.col("peak") - window, F.col("peak") + window - 1)).alias("sample_idx")
    lags = p.select(session, "epoch", "peak", lag).withColumn("lag", F.col("sample_idx") - F.col("peak"))
    near = d.filter("value IS NOT NULL").select(*keys, "sample_idx", "value").join(lags, [session, "epoch", "sample_idx"])
    near = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "peak"))).filter(F.col("_n") == 2 * window)
    template = near.groupBy(*keys, "lag").agg(F.avg("value").alias("t"), F.count(F.lit(1)).alias("_beats")).filter("_beats >= 2").select(*keys, "lag", "t")
    fits = near.join(template, [*keys, "lag"]).groupBy(*keys, "peak").agg(F.sum(F.col("value") * F.col("t")).alias("_xt"), (F.sum(F.col("t") * F.col("t")) + 1e-20).alias("_tt"))
    fits = fits.withColumn("_gap", F.col("peak") - F.lag("peak").over(Window.partitionBy(*keys).orderBy("peak")))
    shifted = fits.filter(F.col("_gap") < 2 * window).select(*keys, F.col("_gap").alias("gap")).distinct()
    ahead = template.select(*keys, (F.col("lag")).alias("_ahead"), F.col("t").alias("_t"))
    own = shifted.join(template, keys).withColumn("_ahead", F.col("lag") + F.col("gap")).join(ahead, [*keys, "_ahead"])
    own = own.groupBy(*keys, F.col("gap").alias("_gap")).agg(F.sum(F.col("t") * F.col("_t")).alias("_own"))
    fits = fits.join(own, [*keys, "_gap"], "left").select(*keys, "peak", (F.col("_xt") / F.col("_tt")).alias("a"), (F.coalesce("_own", F.lit(0.0)) / F.col("_tt")).alias("c"))
    beats = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("peak", "a", "c"))).alias("_b"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<peak:bigint,s:double>>").alias("all"))

    def step(so_far, b):
        s = b["a"] - b["c"] * so_far["s"]
        return F.struct(s.alias("s"), F.concat(so_far["all"], F.array(F.struct(b["peak"].alias("peak"), s.alias("s")))).alias("all"))

    scales = beats.select(*keys, F.explode(F.aggregate("_b", start, step)["all"]).alias("_s")).select(*keys, "_s.peak", "_s.s")
    gone = scales.join(lags, [session, "epoch", "peak"]).join(template, [*keys, "lag"]).groupBy(*keys, "sample_idx").agg(F.sum(F.col("s") * F.col("t")).alias("_g"))
    out = d.join(gone, [*keys, "sample_idx"], "left")
    return out.withColumn("cleaned", F.when(F.col("_g").isNull(), F.col("value")).otherwise(F.col("value") - F.col("_g"))).drop("_g", "epoch")


def heartbeats_removed(samples: DataFrame, session: str, channel: str, *, fs: float, epoch_seconds: float = 30.0, window_seconds: float = 0.5, **how) -> DataFrame:
    """samples with `cleaned`, by the peaks that epoch_peaks finds (how: its further settings)."""
    p = epoch_peaks(samples, session, channel, fs=fs, epoch_seconds=epoch_seconds, window_seconds=window_seconds, **how)
    return remove_beats(samples, p, session, channel, epoch=int(epoch_seconds * fs), window=max(1, int(window_seconds * fs)))
