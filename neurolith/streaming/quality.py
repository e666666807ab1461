"""Signal quality of a live sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_quality(stream: DataFrame, *, window: str = "2 seconds", late: str = "10 seconds", most_rms: float = 150.0) -> DataFrame:
    """stream (session_id, signal, ts, value) -> one row per session, signal and time window: n, rms, ptp, artifact.

    Partial aggregates only; windows close, and their state goes, once the watermark has passed them.
    """
    x = F.col("value")
    w = stream.withWatermark("ts", late).groupBy("session_id", "signal", F.window("ts", window).alias("w"))
    g = w.agg(F.count(x).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), (F.max(x) - F.min(x)).alias("ptp"))
    return g.select("session_id", "signal", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms", "ptp", (F.col("rms") > most_rms).alias("artifact"))
