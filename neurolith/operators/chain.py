"""The EEG cleaning chain as one run over all recordings at once, and its settings.

A recording that cannot be worked on, or that a step fails for, becomes a row of the table of errors, leaves the stream at that
step, and leaves the rest alone.
"""

from __future__ import annotations

import json
import platform
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from neurolith.operators import blocks as B
from neurolith.operators import cleaning as C
from neurolith.operators import components as I
from neurolith.operators import epochs as E
from neurolith.operators import heartbeats as H
from neurolith.operators import kernels as K
from neurolith.operators import line_noise as L
from neurolith.operators import personal as R
from neurolith.operators import spectra as P
from neurolith.operators import wavelets as V
from neurolith.sources.recordings import load_errors


class SettingsError(ValueError):
    """Settings that no run could follow."""


@dataclass(frozen=True)
class Settings:
    """Rates in Hz, times in seconds, amplitudes in the unit of the samples; None leaves a step out."""

    fs: float = 244.0
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    resample_to: int | None = None
    line_frequency: float | None = 50.0
    line_harmonics: tuple[float, ...] = ()
    line_method: str = "sine"
    line_window: float = 4.0
    line_width: float = 2.0
    line_p: float = 0.01
    line_rounds: int = 1
    highpass: float = 1.0
    lowpass: float = 45.0
    filter_method: str = "butter"
    filter_order: int = 2
    least_correlation: float | None = 0.1
    most_spectral_z: float | None = 2.75
    most_line_z: float | None = 7.1
    heart_beats: bool = False
    heart_channels: tuple[str, ...] = ()
    heart_epoch: float = 30.0
    heart_window: float = 0.5
    repair_cutoff: float | None = None
    wavelet: bool = True
    threshold: str = "hard"
    wavelet_block: float | None = 4.0
    wavelet_overlap: float = 0.0
    components: bool = False
    most_slope: float = -0.5
    evoked: bool = False
    epoch: float = 2.0
    before: float = 0.2
    after: float = 0.8
    baseline: bool = True
    most_amplitude: float | None = 150.0
    most_surprisal_sd: float | None = 3.0
    rejection_channels: tuple[str, ...] | None = None
    reference: str | None = "average"
    reference_channels: tuple[str, ...] = ()
    pulled_channel: str | None = None

    def checked(self) -> Settings:
        """The settings themselves, or a SettingsError that names the first that cannot be."""
        rules = {
            "fs": self.fs > 0, "highpass": 0 < self.highpass < self.lowpass, "filter_order": self.filter_order >= 1, "threshold": self.threshold in ("hard", "soft"),
            "reference": self.reference in ("average", "subset", None), "reference_channels": self.reference != "subset" or bool(self.reference_channels), "epoch": self.epoch * self.fs >= 2, "line_window": self.line_window * self.fs >= 4,
            "wavelet_block": self.wavelet_block is None or self.wavelet_block > 0, "before": self.before >= 0 and self.after >= 0,
            "line_method": self.line_method in ("sine", "tapers", "notch"), "line_width": self.line_width > 0, "line_p": 0 < self.line_p < 1, "line_rounds": 1 <= self.line_rounds <= 10, "filter_method": self.filter_method in ("butter", "fir"), "wavelet_overlap": 0 <= self.wavelet_overlap < 1,
            "resample_to": self.resample_to is None or (self.resample_to > 0 and float(self.fs).is_integer()), "heart_window": 0 < 3 * self.heart_window <= self.heart_epoch,
        }
        for name, holds in rules.items():
            if not holds:
                raise SettingsError(f"{name}: {getattr(self, name)!r}")
        return self

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a mapping; a name that is no setting is an error, lists become tuples."""
        known = {f.name for f in fields(cls)}
        if extra := sorted(set(values) - known):
            raise SettingsError(f"unknown: {', '.join(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}).checked()

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls.of(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


#: What evoked responses start from: soft thresholds and a band of 0.1 to 30 Hz.
EVOKED = Settings(evoked=True, threshold="soft", highpass=0.1, lowpass=30.0)


def stage_folder(spark: SparkSession) -> str:
    """A new folder for a run's stages: in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/chain-{uuid.uuid4().hex}"


class Stages:
    """The tables of a run: each is written under a folder and read again, its rows are counted in the same pass, and
    recordings with an error in it leave the stream."""

    def __init__(self, spark: SparkSession, place: str, session: str, channel: str):
        self.spark, self.place, self.keys, self.rows, self.errors = spark, place, [session, channel], {}, []

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.place}/{name}")
        self.rows[name] = seen.get.get("rows", 0)
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def fail(self, step: str, found: DataFrame) -> DataFrame:
        """Write error rows (session, error_type, message) of a step; they are read again."""
        found = self.keep(f"errors_{step}", found.withColumn("step", F.lit(step)))
        self.errors.append(found)
        return found

    def step(self, step: str, df: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
        """Write what a step gave and read it again without the recordings it failed for: those with an _error, or with a
        number that is not finite in one of the columns."""
        session, channel = self.keys
        odd = F.lit(False)
        for c in columns:
            odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        t = df if "_error" in df.columns else df.withColumn("_error", F.lit(None).cast("string"))
        t = self.keep(step, t.withColumn("_error", F.coalesce("_error", F.when(odd, "ArithmeticError: the result is not finite"))))
        first = F.min(F.concat_ws(": ", channel, "_error"))
        gone = self.fail(step, t.filter("_error IS NOT NULL").groupBy(session).agg(first.alias("message")).select(session, F.lit("StepFailed").alias("error_type"), "message"))
        return t.join(gone.select(session), session, "left_anti").drop("_error")


def step_measures(d: DataFrame, session: str, channel: str, prefix: str, *, size: int, freqs: list[float], fs: float) -> DataFrame:
    """d (session, channel, sample_idx, pre, post) -> one row for each session of what a step changed, names with the prefix:
    the measures of step_quality over whole segments of `size` samples, coherence at freqs (mean over channels), and
    percent_variance_retained over all samples."""
    keys = [session, channel]
    s = P.segments(d, keys, ["pre", "post"], size, size).withColumnRenamed(channel, "channel")
    out = E.step_quality(s, session)
    retained = d.groupBy(session).agg((F.var_pop("post") * 100 / F.nullif(F.var_pop("pre"), F.lit(0.0))).alias("percent_variance_retained"))
    out = retained.join(out, session, "left")
    if freqs:
        cross = P.cross_density(d, keys, "pre", "post", fs=fs, size=size)
        both = F.col("pxx") * F.col("pyy")
        near = P.nearest_bin(cross, keys, freqs, F.when(both > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / both))
        out = out.join(near.groupBy(session).agg(*[F.avg(F.when(F.col("target") == float(f), F.col("value"))).alias(f"coherence_{f:g}Hz".replace(".", "_")) for f in freqs]), session, "left")
    return out.select(session, *[F.col(c).alias(f"{prefix}_{c}") for c in out.columns if c != session])


def run(samples: DataFrame, settings: Settings, events: DataFrame | None = None, *, folder: str | None = None, session: str = "session_id", channel: str = "signal", own: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> dict[str, DataFrame]:
    """samples (session, channel, sample_idx, value) -> tables cleaned, channels, epochs, quality, steps, errors and record.

    Channels, rate, line noise, band-pass, bad channels (flat, uncorrelated, odd spectrum or line noise; left out of what
    follows), heart beats, repair, wavelets, components, own steps (name: function of a series' values), reference, epochs (fixed, or about
    events in evoked runs), baseline, rejection. Epochs of the table all stay; rejected says which fail, by the
    rejection_channels where there are any. A pulled_channel is taken out at first and put back as zeros before the average
    reference. Evoked runs take events (session, onset, tag) at the rate that the samples are cleaned at; recordings without
    any are errors. Samples count from 0 without holes.

    errors has session, error_type, message and step. A recording for which a step raises, or gives a number that is not
    finite, is one row there and in no later table; others are as if it had not been. record is one row: settings, versions,
    time, and the rows of each table, counted as it was written. Each stage is written under `folder` and read again, so
    later ones don't work it out anew and a lost executor costs no more than the stage at hand.
    """
    o = settings.checked()
    if o.evoked and events is None:
        raise SettingsError("evoked: no events")
    keys, spark = [session, channel], samples.sparkSession
    stages = Stages(spark, folder or stage_folder(spark), session, channel)
    kept = stages.keep
    pulled = (o.pulled_channel,) if o.pulled_channel and o.reference == "average" else ()

    d = C.kept_channels(samples.select(*keys, "sample_idx", "value"), channel, include=list(o.include) if o.include is not None else None, exclude=[*o.exclude, *pulled])
    found = load_errors(d, session, channel)
    if o.evoked:
        found = found.unionByName(C.untagged(d.join(found.select(session), session, "left_anti"), events, session))
    d = d.join(stages.fail("load", found).select(session).distinct(), session, "left_anti")
    fs = float(o.resample_to or o.fs)
    if o.resample_to and o.resample_to != o.fs:
        d = stages.step("resample", B.resample(d, keys, old=int(o.fs), new=o.resample_to))
    size, size_4 = int(o.epoch * fs), max(8, int(4 * fs))
    measures = []
    if o.line_frequency:
        freqs = [f for f in dict.fromkeys((o.line_frequency, 2 * o.line_frequency, *o.line_harmonics)) if f < fs / 2]
        if o.line_method == "sine":
            line = C.remove_line(d, keys, fs=fs, freqs=freqs, seconds=o.line_window, rounds=o.line_rounds).select(*keys, "sample_idx", F.col("value").alias("pre"), F.col("cleaned").alias("post"))
        else:
            if o.line_method == "tapers":
                post = L.remove_tested_lines(d, keys, fs=fs, freqs=freqs, seconds=o.line_window, bandwidth=o.line_width, p=o.line_p, rounds=o.line_rounds)[0].withColumnRenamed("cleaned", "post")
            else:
                post = B.notch_band(d, keys, fs=fs, freqs=freqs, width=o.line_width).withColumnRenamed("filtered", "post")
            line = d.withColumnRenamed("value", "pre").join(post, [*keys, "sample_idx"], "left")
        line = stages.step("line", line, ("post",))
        measures.append(kept("line_measures", step_measures(line, session, channel, "lineNoise", size=size_4, freqs=[f for f in freqs if f < fs / 2], fs=fs)))
        d = line.select(*keys, "sample_idx", F.col("post").alias("value"))
    if o.filter_method == "fir":
        d = B.fir_band_pass(d, keys, fs=fs, low=o.highpass, high=o.lowpass)
    else:
        d = K.band_pass(d, keys, fs=fs, low=o.highpass, high=o.lowpass, order=o.filter_order, failing=True)
    before = line.select(*keys, "sample_idx", "pre") if o.line_frequency else None
    d = stages.step("filter", d.withColumnRenamed("filtered", "value"))
    if before is not None:
        bands = R.band_power_retained(before.join(d.withColumnRenamed("value", "post"), [*keys, "sample_idx"]), session, channel, fs=fs)
        measures.append(kept("band_measures", bands))
    fixed = P.segments(d, keys, ["value"], size, size).select(session, F.col(channel).alias("channel"), F.col("segment").alias("epoch"), F.col("value").alias("a"))
    found = E.bad_channels(fixed, session, o.least_correlation if o.least_correlation is not None else 0.0)
    channels = d.select(*keys).distinct().join(found.withColumnRenamed("channel", channel), keys, "left")
    marks = ["flat", "uncorrelated"]
    if o.most_spectral_z is not None or o.most_line_z is not None:
        density = kept("density", P.power_density(d, keys, fs=fs, size=size_4))
        if o.most_spectral_z is not None:
            odd = P.spectral_outliers(density, [session], channel, z_low=-o.most_spectral_z, z_high=o.most_spectral_z)
            channels, marks = channels.join(odd.select(*keys, "spectral_outlier"), keys, "left"), [*marks, "spectral_outlier"]
        if o.most_line_z is not None and o.line_frequency:
            odd = P.line_noise_outliers(density, [session], channel, line=o.line_frequency, most_z=o.most_line_z)
            channels, marks = channels.join(odd.select(*keys, "line_noise_outlier"), keys, "left"), [*marks, "line_noise_outlier"]
    bad = F.lit(False)
    for m in marks:
        bad = bad | F.coalesce(F.col(m), F.lit(False))
    channels = kept("channels", channels.withColumn("bad", bad))
    d = d.join(channels.filter("bad").select(*keys), keys, "left_anti")
    if o.heart_beats:
        d = H.heartbeats_removed(d, session, channel, fs=fs, epoch_seconds=o.heart_epoch, window_seconds=o.heart_window, heart_channels=list(o.heart_channels) or None)
        d = stages.step("heart_beats", d.select(*keys, "sample_idx", F.col("cleaned").alias("value")))
    if o.repair_cutoff:
        d = stages.step("repair", K.tddr(d, keys, fs=fs, cutoff=o.repair_cutoff, failing=True).withColumnRenamed("repaired", "value"))
    if o.wavelet:
        name, level = C.wavelet_choice(o.evoked, fs)
        d = V.wavelet_clean(d, keys, fs=fs, wavelet=name, level=level, soft=o.threshold == "soft", block_seconds=o.wavelet_block, overlap=o.wavelet_overlap)
        d = stages.step("wavelet", d.select(*keys, "sample_idx", F.col("value").alias("pre"), F.col("cleaned").alias("post")), ("post",))
        measures.append(kept("wavelet_measures", step_measures(d, session, channel, "wavelet", size=size_4, freqs=[], fs=fs)))
        d = d.select(*keys, "sample_idx", F.col("post").alias("value"))
    if o.components:
        v, model = I.unmixing(d, session, channel, f"{stages.place}/components")
        parts = kept("component_values", I.component_values(v, model, session))
        marks = kept("component_marks", I.muscle_components(parts, session, fs=fs).withColumn("muscle", F.coalesce(F.col("slope") > o.most_slope, F.lit(False))))
        rejected = kept("components_rejected", I.rejection_row(marks, session))
        none_left = rejected.filter("all_rejected").select(session, F.lit("AllComponentsRejected").alias("error_type"), F.lit("no component is left").alias("message"))
        d = I.remove_components(d, parts, model, marks, session, channel).select(*keys, "sample_idx", F.col("cleaned").alias("value"))
        d = stages.step("components", d.join(stages.fail("component_choice", none_left).select(session), session, "left_anti"))
        measures.append(rejected.select(session, "n_components", "n_rejected", "pct_rejected"))
    for name, f in (own or {}).items():
        d = stages.step(name, K.own_step(d, keys, f, failing=True).withColumnRenamed("changed", "value"))
    if pulled:
        d = C.with_reference(d, keys, channel, pulled[0])
    if o.reference is not None:
        of = d if o.reference == "average" else d.filter(F.col(channel).isin(*o.reference_channels))
        mean = of.groupBy(session, "sample_idx").agg(F.avg("value").alias("_m"))
        d = d.join(mean, [session, "sample_idx"], "left").select(*keys, "sample_idx", (F.col("value") - F.coalesce("_m", F.lit(0.0))).alias("value"))
    d = kept("cleaned", d)
    if o.evoked:
        e = C.event_epochs(d, events, keys, before=int(o.before * fs), after=int(o.after * fs)).select(*keys, F.col("onset").alias("epoch"), "tag", F.col("epoch").alias("a"))
        if o.baseline and int(o.before * fs) > 0:
            e = e.withColumn("_b", F.slice("a", 1, int(o.before * fs))).withColumn("_m", F.aggregate("_b", F.lit(0.0), lambda s, x: s + x) / F.size("_b"))
            e = e.withColumn("a", F.transform("a", lambda x: x - F.col("_m"))).drop("_b", "_m")
    else:
        e = P.segments(d, keys, ["value"], size, size).select(*keys, F.col("segment").alias("epoch"), F.lit(None).cast("string").alias("tag"), F.col("value").alias("a"))
    e = kept("cut", e.withColumnRenamed(channel, "channel"))
    looked = e.filter(F.col("channel").isin(*o.rejection_channels)) if o.rejection_channels is not None else e
    whole = looked.groupBy(session, "epoch").agg(F.max(F.array_max(F.transform("a", F.abs))).alias("max_abs"))
    whole = whole.withColumn("rejected", F.col("max_abs") > o.most_amplitude if o.most_amplitude is not None else F.lit(False))
    if o.most_surprisal_sd is not None:
        odd = E.joint_probability(looked, session, o.most_surprisal_sd).select(session, "epoch", F.col("rejected").alias("_odd"))
        whole = whole.join(odd, [session, "epoch"], "left").withColumn("rejected", F.col("rejected") | F.coalesce("_odd", F.lit(False))).drop("_odd")
    epochs = e.join(whole, [session, "epoch"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    epochs = kept("epochs", epochs)
    quality = kept("quality", C.quality_row(samples, channels, epochs.select(session, "epoch", "rejected").distinct(), session))
    steps = d.select(session).distinct()
    for m in measures:
        steps = steps.join(m, session, "left")
    steps, errors = kept("steps", steps), stages.errors[0]
    for x in stages.errors[1:]:
        errors = errors.unionByName(x)
    errors = kept("errors", errors)
    facts = {"settings": asdict(o), "rows": stages.rows, "spark": spark.version, "python": platform.python_version(), "own_steps": list(own or {}), "ended_utc": datetime.now(UTC).isoformat(timespec="seconds")}
    record = spark.createDataFrame([(json.dumps(facts, indent=2),)], "record string")
    record.coalesce(1).write.mode("overwrite").text(f"{stages.place}/record")
    return {"cleaned": d, "channels": channels, "epochs": epochs, "quality": quality, "steps": steps, "errors": errors, "record": record}
