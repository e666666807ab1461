"""The optical study as one run: from a folder of sessions to tables of phases, sessions, changes and events, its log and its record."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurolith.operators import features as X
from neurolith.operators import haemodynamics as H
from neurolith.operators import kernels as K
from neurolith.operators import spectra as P
from neurolith.operators import tables as B
from neurolith.sources import recordings as R

KEY = ["folder"]

#: The flags of each tier. Flags of the last tier describe statistics and fail no row.
TIERS = {
    "input": ("MISSING_FILE", "EMPTY_FILE", "INVALID_COLUMNS", "INVALID_SAMPLING_RATE", "DUPLICATED_TIMESTAMP", "NON_MONOTONIC_TIME"),
    "signal": ("HIGH_NAN_RATIO", "FLAT_SIGNAL", "SATURATION", "EXTREME_PEAK_TO_PEAK", "EXTREME_SD", "EXTREME_SLOPE", "BASELINE_SHIFT", "EXCESSIVE_MOTION", "HBT_INCONSISTENT"),
    "event": ("MISSING_PHASE", "INCOMPLETE_PHASES", "EVENT_OUT_OF_RANGE", "EVENT_CLIPPED", "PHASE_OVERLAP", "INVALID_EVENT_ORDER", "DURATION_MISMATCH", "ALIGNMENT_UNCERTAIN"),
    "baseline": ("MISSING_BASELINE", "INVALID_BASELINE", "BASELINE_HIGH_VARIABILITY"),
    "stat": ("ROBUST_OUTLIER",),
}


@dataclass(frozen=True)
class Settings:
    """Rates in Hz, lengths in seconds. exclusion is what the stable variant of a phase leaves out at its start."""

    fs: float = 100.0
    clock: float = 244.0
    repair: bool = True
    lowpass: float | None = 0.2
    highpass: float | None = None
    detrend: str | None = "linear"
    bins: int = 2000
    least_finite: float = 0.95
    least_phase: float = 30.0
    least_third: float = 30.0
    baseline_phase: str = "REST_BEFORE"
    baseline_seconds: float = 30.0
    least_baseline: float = 10.0
    baseline_ratio: float = 3.0
    exclusion: dict[str, float] = field(default_factory=lambda: {"REST_BEFORE": 5.0, "MEDITATION": 15.0, "REST_AFTER": 5.0})
    otherwise: float = 5.0
    window: float = 120.0
    step: float = 30.0
    low_band: tuple[float, float] = (0.02, 0.1)
    total_band: tuple[float, float] = (0.02, 0.2)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings with the values that the JSON object names; one that it doesn't know is a ValueError."""
        given = json.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def flag_tiers(rows: DataFrame, flags: str) -> DataFrame:
    """`;`-joined flags, counted once each: qc_flag_count, has_<tier>_flag of each tier, and qc_pass, false where any but a
    statistical flag of a tier is set. Flags of no tier count and fail nothing; no row is dropped."""
    d = rows.withColumn("_f", F.array_distinct(F.filter(F.split(F.coalesce(F.col(flags), F.lit("")), ";"), lambda x: x != "")))
    d = d.withColumn("qc_flag_count", F.size("_f"))
    d = d.withColumns({f"has_{t}_flag": F.arrays_overlap("_f", F.array(*[F.lit(x) for x in names])) for t, names in TIERS.items()}).drop("_f")
    return d.withColumn("qc_pass", ~(F.col("has_input_flag") | F.col("has_signal_flag") | F.col("has_event_flag") | F.col("has_baseline_flag")))


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    """(qc_flag, n_rows): how many rows have each flag; a row counts each of its flags once."""
    each = F.explode(F.array_distinct(F.filter(F.split(F.col(flags), ";"), lambda x: x != ""))).alias("qc_flag")
    return rows.select(each).groupBy("qc_flag").agg(F.count(F.lit(1)).alias("n_rows"))


def segment_measures(
    session: DataFrame, segments: DataFrame, keys: list[str], *, fs: float, cutoff: float | None = 0.2, seconds: float = 120.0,
    low: tuple[float, float] = (0.02, 0.1), total: tuple[float, float] = (0.02, 0.5),
) -> DataFrame:
    """session (keys, sample_idx, hbo, hbr, hbt) and segments (keys, segment, start_idx, stop_idx) -> one row a segment that has
    samples: segment_duration_s, n_samples, of each signal the mean, sd, slope per minute, peak to peak, max and min in uM, then
    low_freq_power_ratio of hbo and freq_domain_duration_s.

    Each segment is low-passed by itself (not at all without a cutoff), with missing values as its median. Segments shorter than
    two seconds have no measures; the share of the low band in the total one needs `seconds`, the length of its windows too,
    which overlap by half. Segments may overlap.
    """
    part = [*keys, "segment"]
    inside = B.in_segments(session.select(*keys, "sample_idx", *H.SIGNALS), segments.select(*part, "start_idx", "stop_idx"), keys)
    long = inside.select(*part, (F.col("sample_idx") - F.col("start_idx")).alias("sample_idx"), *H.SIGNALS).unpivot([*part, "sample_idx"], list(H.SIGNALS), "signal", "value")

    def smooth(x: np.ndarray) -> np.ndarray:
        some = np.isfinite(x)
        x = np.where(some, x, np.median(x[some]) if some.any() else 0.0)
        return K.one_sided(x, fs, cutoff, "low") if cutoff and len(x) >= 2 * fs else x

    d = K.own_step(long, [*part, "signal"], smooth)
    is_, x, minutes = lambda s: F.col("signal") == s, F.col("changed"), F.col("sample_idx") / (fs * 60)
    of = lambda f, s: f(F.when(is_(s), x))
    n = F.count_if(is_("hbo"))
    enough = n >= max(2, int(fs * 2))
    measures = [F.when(enough, c).alias(f"{s}_{name}") for s in H.SIGNALS for name, c in {
        "mean_uM": of(F.avg, s), "sd_uM": of(F.stddev_samp, s), "slope_uM_per_min": F.regr_slope(F.when(is_(s), x), F.when(is_(s), minutes)),
        "peak_to_peak_uM": of(F.max, s) - of(F.min, s), "max_uM": of(F.max, s), "min_uM": of(F.min, s),
    }.items()]
    g = d.groupBy(*part).agg((n / fs).alias("segment_duration_s"), n.alias("n_samples"), *measures, F.when(enough, n / fs).otherwise(0.0).alias("freq_domain_duration_s"))
    named = [*keys, "_segment"]
    density = P.power_density(d.filter(is_("hbo")).select(*keys, F.col("segment").alias("_segment"), "sample_idx", x.alias("value")), named, fs=fs, size=int(fs * seconds))
    shares = density.groupBy(*keys, F.col("_segment").alias("segment")).agg(P.ratio(P.area(*low), P.area(*total)).alias("low_freq_power_ratio"))
    return g.join(shares, part, "left")


def baselines(processed: DataFrame, phases: DataFrame, o: Settings) -> tuple[DataFrame, DataFrame]:
    """(folder, signal, baseline) by the median of the last baseline_seconds of the baseline phase, and (folder, flag) where it
    is shorter than least_baseline (no baseline then), or hbo spreads more in it than baseline_ratio times its MAD, scaled, in
    the whole recording (or has none)."""
    rest = phases.filter(F.col("phase") == o.baseline_phase).withColumn("_ok", (F.col("stop_idx") - F.col("start_idx")) / o.fs >= o.least_baseline)
    late = F.greatest(F.col("start_idx"), F.col("stop_idx") - F.round(F.lit(o.baseline_seconds * o.fs)).cast("long"))
    own = B.in_segments(processed.select(*KEY, "sample_idx", *H.SIGNALS), rest.filter("_ok").select(*KEY, late.alias("start_idx"), "stop_idx"), KEY)
    b = own.unpivot(KEY, list(H.SIGNALS), "signal", "value").groupBy(*KEY, "signal").agg(F.median("value").alias("baseline"), F.stddev_pop("value").alias("_sd"))
    mid = processed.groupBy(*KEY).agg(F.median("hbo").alias("_m"))
    mad = processed.join(mid, KEY).groupBy(*KEY).agg((1.4826 * F.median(F.abs(F.col("hbo") - F.col("_m")))).alias("_mad"))
    calm = (F.col("_mad") > 1e-9) & (F.col("_sd") <= o.baseline_ratio * F.col("_mad"))
    loud = b.filter("signal = 'hbo'").join(mad, KEY).filter(~F.coalesce(calm, F.lit(False))).select(*KEY, F.lit("BASELINE_HIGH_VARIABILITY").alias("flag"))
    return b.select(*KEY, "signal", "baseline"), rest.filter("NOT _ok").select(*KEY, F.lit("INVALID_BASELINE").alias("flag")).unionByName(loud)


def phase_places(checked: DataFrame, n: DataFrame, o: Settings) -> DataFrame:
    """Both variants of each valid phase, the thirds of meditations whose stable part lasts least_third seconds or more (as both), and of OVERALL for
    recordings without any phase, which have the flag MISSING_PHASE. A name that comes again is told apart by #2 and so on."""
    variants = F.array(F.lit("full_phase"), F.lit("stable_phase"))
    again = F.row_number().over(Window.partitionBy(*KEY, "phase").orderBy("start_idx", "stop_idx"))
    fine = checked.filter((F.col("status") != "invalid") & (F.col("stop_idx") > F.col("start_idx"))).withColumn("_again", again)
    fine = fine.select(*KEY, F.concat("phase", F.when(F.col("_again") > 1, F.concat(F.lit("#"), "_again")).otherwise("")).alias("phase"), "start_idx", "stop_idx")
    both = B.phase_segments(fine, o.fs, exclusion=o.exclusion, otherwise=o.otherwise, least_seconds=o.least_phase)
    part = F.element_at(F.array(F.lit("EARLY"), F.lit("MIDDLE"), F.lit("LATE")), F.col("part") + 1)
    cut = X.thirds(both.filter("variant = 'stable_phase' AND phase LIKE 'MEDITATION%'"), "start_idx", "stop_idx", o.least_third * o.fs)
    cut = cut.select(*KEY, F.concat_ws("_", "phase", part).alias("phase"), F.explode(variants).alias("variant"), F.col("part_start").alias("start_idx"), F.col("part_stop").alias("stop_idx"), ((F.col("part_stop") - F.col("part_start")) / o.fs).alias("duration_seconds"), F.lit(None).cast("string").alias("flag"))
    none = n.join(fine.select(*KEY).distinct(), KEY, "left_anti")
    whole = none.select(*KEY, F.lit("OVERALL").alias("phase"), F.explode(variants).alias("variant"), F.lit(0).cast("long").alias("start_idx"), F.col("n").alias("stop_idx"), (F.col("n") / o.fs).alias("duration_seconds"), F.lit("MISSING_PHASE").alias("flag"))
    return both.unionByName(cut).unionByName(whole)


METRICS = ["mean", "median", "sd", "mad", "iqr", "ptp", "trimmed10", "auc", "robust_slope_per_min", "mean_delta", "median_delta", "auc_delta"]
PAIRS = [("REST_BEFORE", "MEDITATION"), ("MEDITATION", "REST_AFTER"), ("REST_BEFORE", "REST_AFTER")]


def study_tables(processed: DataFrame, sessions: DataFrame, validity: DataFrame, events: DataFrame, before: DataFrame, o: Settings) -> dict[str, DataFrame]:
    """The tables of a study, all sessions at once.

    processed (folder, sample_idx, hbo, hbr, hbt), sessions (folder, input_signal_stage, input_qc_flags), validity (folder,
    flags), events (folder, phase, start_s, duration_s), before (folder, n_samples_before). phase_by_phase has a row for every
    session with samples, phase, variant and signal; run_log one for every session, NO_INPUT_DATA where nothing could be read.
    A session without events is one phase, OVERALL. Flags never drop a row.
    """
    n = processed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    at = lambda c: F.bround(c * o.fs).cast("long")
    e = events.join(n, KEY).select(*KEY, "phase", at(F.col("start_s")).alias("start_idx"), at(F.col("start_s") + F.col("duration_s")).alias("stop_idx"), "n")
    checked = B.event_checks(e, "folder", list(X.PHASES), n_samples=F.col("n"), fs=o.fs).drop("n")
    segments = phase_places(checked, n, o)
    baseline, odd = baselines(processed, segments.filter("variant = 'full_phase'"), o)
    spread = lambda d, c: d.select(*KEY, F.explode(F.split(c, ";")).alias("flag"))
    some = spread(sessions, "input_qc_flags").unionByName(spread(validity, "flags")).unionByName(spread(checked, "flags")).unionByName(odd)
    some = some.unionByName(segments.filter("phase = 'OVERALL'").select(*KEY, "flag")).unionByName(n.join(baseline.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit("MISSING_BASELINE").alias("flag")))
    flags = some.filter("flag <> ''").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("flag")), ";").alias("session_qc_flags"))

    part = [*KEY, "phase", "variant"]
    metrics = H.phase_metrics(processed, segments, baseline, KEY, fs=o.fs, bins=o.bins)
    low = H.segment_low_ratio(processed, segments, KEY, fs=o.fs, seconds=o.window, step_seconds=o.step, low=o.low_band, total=o.total_band).withColumnRenamed("n_windows", "n_spectral_windows")
    own = H.segment_flags(processed, segments, baseline, KEY).select(*part, "start_idx", "stop_idx", "duration_seconds", "hbt_residual", "qc_flags")
    rows = own.join(metrics, part, "left").join(low, part, "left").join(flags, KEY, "left").join(sessions.select(*KEY, "input_signal_stage"), KEY, "left").fillna({"session_qc_flags": ""})
    rows = flag_tiers(rows.withColumn("_all", F.concat_ws(";", "qc_flags", "session_qc_flags")), "_all")
    changes = X.phase_changes(metrics, [*KEY, "variant", "signal"], METRICS, PAIRS)
    names = [f"{p}__{v}__{s}__{m}" for p in (*X.PHASES, "OVERALL") for v in ("full_phase", "stable_phase") for s in H.SIGNALS for m in METRICS]
    log = sessions.join(before, KEY, "left").join(n.withColumnRenamed("n", "n_samples_after"), KEY, "left").join(flags, KEY, "left").fillna({"session_qc_flags": ""})
    log = log.withColumns({"length_unchanged": F.col("n_samples_before") == F.col("n_samples_after"), "status": F.when(F.col("n_samples_after").isNull(), "NO_INPUT_DATA").otherwise("OK")})
    return {
        "phase_by_phase": rows.drop("_all"), "wide_by_session": B.wide_metrics(metrics, KEY, ["phase", "variant", "signal"], METRICS, names), "session_changes": changes,
        "event_alignment": checked, "run_log": log, "qc_summary": flag_counts(rows, "_all"),
    }


def run_record(spark: SparkSession, o: Settings, counts: dict[str, int]) -> DataFrame:
    """One row, a record as JSON: versions, the time in UTC, the settings, and counts."""
    made = json.dumps({"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "settings": asdict(o), **counts}, sort_keys=True)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("made_at")
    return spark.range(1).select(stamp, F.lit(made).alias("record"))


def run_study(spark: SparkSession, path: str, out: str, o: Settings | None = None, *, events: str = "event_labels_block.csv") -> dict[str, DataFrame]:
    """Read every session folder under `path`, write the processed signals and all tables below `out`, and give them read again.

    Tables are Parquet: processed, those of study_tables (with what the path says of participant, day and session), input_hashes,
    and record. The processed signals are written before anything is worked out of them, so nothing is filtered twice and a
    lost executor costs its tasks alone.
    """
    o = o or Settings()
    raw, conc, sessions = R.read_optical_sessions(spark, path)
    raw = raw.join(sessions.filter("input_signal_stage = 'raw_intensity'").select(*KEY), KEY, "left_semi")
    how = {"fs": o.fs, "repair": o.repair, "highpass": o.highpass, "lowpass": o.lowpass, "detrend": o.detrend, "bins": o.bins}
    done = H.preprocess(raw, KEY, stage="intensity", **how).unionByName(H.preprocess(conc, KEY, stage="concentration", **how))
    R.write_tables({"processed": done}, out)
    processed = spark.read.parquet(f"{out}/processed")
    long = raw.unpivot([*KEY, "sample_idx"], ["i740", "i850"], "signal", "value").unionByName(conc.unpivot([*KEY, "sample_idx"], ["hbo", "hbr"], "signal", "value"))
    valid = B.signal_validity(long, [*KEY, "signal"], o.fs, least_finite=o.least_finite)
    before = raw.select(*KEY).unionByName(conc.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_samples_before"))
    ev = R.read_events(spark, path, o.clock, name=events).withColumn("folder", F.regexp_replace("file", r"/[^/]*$", ""))
    tables = study_tables(processed, sessions, valid.select(*KEY, "flags"), ev.select(*KEY, F.col("description").alias("phase"), "start_s", "duration_s"), before, o)
    R.write_tables({name: B.in_front(t.withColumns(R.identity(F.col("folder"))), ["participant_key", "study_day", "session_id"]) for name, t in tables.items() if name != "qc_summary"}, out)
    R.write_tables({"qc_summary": tables["qc_summary"], "input_hashes": R.file_hashes(spark, path, "*.csv")}, out)
    read = {name: spark.read.parquet(f"{out}/{name}") for name in [*tables, "processed", "input_hashes"]}
    R.write_tables({"record": run_record(spark, o, {"n_sessions": read["run_log"].count(), "n_phase_rows": read["phase_by_phase"].count()})}, out)
    return {**read, "record": spark.read.parquet(f"{out}/record")}
