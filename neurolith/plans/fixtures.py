"""The given tables in the roles of the engine's inputs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNALS = {"click": "AF3", "view": "AF4", "purchase": "PPG", "signup": "fNIRS_1", "error": "fNIRS_2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: five-day sessions, event types as signals, places in the order of time."""
    e = table(spark, sf_dir, "events")
    signal = F.lit("fNIRS_2")
    for k, v in SIGNALS.items():
        signal = F.when(F.col("event_type") == k, v).otherwise(signal)
    e = e.select(F.floor((F.dayofmonth("ts") - 1) / 5).alias("session_id"), signal.alias("signal"), "ts", "event_id", "user_id", "value")
    place = F.row_number().over(Window.partitionBy("session_id", "signal").orderBy("ts", "event_id")) - 1
    return e.withColumn("sample_idx", place.cast("long"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the third of their session that they lie in as phase."""
    s = samples(spark, sf_dir)
    third = F.floor(F.col("sample_idx") * 3 / F.count(F.lit(1)).over(Window.partitionBy("session_id", "signal")))
    return s.withColumn("phase", F.when(third == 0, "REST_BEFORE").when(third == 1, "MEDITATION").otherwise("REST_AFTER"))


SQL = """
WITH s AS (SELECT CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS session_id,
    CASE event_type WHEN 'click' THEN 'AF3' WHEN 'view' THEN 'AF4' WHEN 'purchase' THEN 'PPG' WHEN 'signup' THEN 'fNIRS_1' ELSE 'fNIRS_2' END AS signal, ts, event_id, user_id, value,
    CAST(row_number() OVER (PARTITION BY floor((day(ts) - 1) / 5), event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_idx FROM events),
ph AS (SELECT *, CASE CAST(floor(sample_idx * 3 / count(*) OVER (PARTITION BY session_id, signal)) AS BIGINT) WHEN 0 THEN 'REST_BEFORE' WHEN 1 THEN 'MEDITATION' ELSE 'REST_AFTER' END AS phase FROM s)"""
