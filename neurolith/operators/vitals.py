"""Heart and breath measures of parts of a recording: each segment's samples are filtered and searched on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import kernels as K
from neurolith.operators import tables as B


def in_named_segments(samples: DataFrame, segments: DataFrame, session: str, *, fs: float) -> DataFrame:
    """samples (session, sample_idx, value) of each segment (session, segment, start_s, stop_s), one row for each that holds it."""
    at = lambda c: F.bround(F.col(c) * fs).cast("long")
    s = segments.select(session, "segment", at("start_s").alias("start_idx"), at("stop_s").alias("stop_idx"))
    return B.in_segments(samples.select(session, "sample_idx", "value"), s, [session])


def segment_hrv(samples: DataFrame, segments: DataFrame, session: str, *, fs: float, apart: float = 0.35, least_seconds: float = 1.5) -> DataFrame:
    """A row for each segment with its heart measures from beats 0.30 to 1.80 s apart; NO_VALID_IBI where there are none."""
    keys = [session, "segment"]
    d = in_named_segments(samples, segments, session, fs=fs)
    at = K.series_peaks(d, keys, fs=fs, chain="ppg", apart=apart, prominent=True, least_seconds=least_seconds).filter("at IS NOT NULL")
    measures = X.hrv(X.intervals(at, keys, "at", 1.0, 0.30, 1.80), keys, "at")
    return segments.select(*keys, "start_s", "stop_s").join(measures, keys, "left").fillna({"n_ibi": 0, "quality_flag": "NO_VALID_IBI"})


def segment_breathing(samples: DataFrame, segments: DataFrame, session: str, *, fs: float, apart: float = 2.0, least_seconds: float = 30.0) -> DataFrame:
    """A row for each segment with its breaths 2 to 10 s apart; NO_VALID_BREATHS where there are none."""
    keys = [session, "segment"]
    d = in_named_segments(samples, segments, session, fs=fs)
    at = K.series_peaks(d, keys, fs=fs, chain="respiration", apart=apart, prominent=False, least_seconds=least_seconds).filter("at IS NOT NULL")
    measures = X.breathing(X.intervals(at, keys, "at", 1.0, 2.0, 10.0), keys)
    return segments.select(*keys, "start_s", "stop_s").join(measures, keys, "left").fillna({"n_bbi": 0, "quality_flag": "NO_VALID_BREATHS"})


def window_segments(events: DataFrame, session: str, seconds: float) -> DataFrame:
    """events (session, phase, start_s, stop_s) -> a segment <phase>/<window> for each window of `seconds` from its start on."""
    w = X.anchored_windows(events, seconds)
    return w.select(session, F.concat_ws("/", "phase", F.lpad(F.col("window").cast("string"), 5, "0")).alias("segment"), F.col("from_s").alias("start_s"), F.col("to_s").alias("stop_s"))


def window_series(measured: DataFrame, session: str, columns: dict[str, str], places: int = 1) -> DataFrame:
    """Measured windows as points of a series: phase, t (the middle of the window in seconds) and the columns (name: as), rounded;
    windows in which all of them are missing are left out."""
    d = measured.select(session, F.split_part("segment", F.lit("/"), F.lit(1)).alias("phase"), ((F.col("start_s") + F.col("stop_s")) / 2).alias("t"), *[F.round(c, places).alias(a) for c, a in columns.items()])
    return d.dropna(how="all", subset=list(columns.values()))
