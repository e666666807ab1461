"""From measured signals to a decision on the session: labels of signals, of the recording, and of the whole, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.operators.tables import distinct_reasons

#: Fixed limits: per cent of samples missing and clipped, seconds flat, per cent of windows, spreads, beats, coupling.
LIMITS = {
    "missing": 2.0, "clipping": 1.0, "flatline": 1.0, "artifact_severe": 30.0, "artifact_moderate": 10.0, "dynamic_eeg": 20.0, "dynamic_ppg_fail": 100.0, "dynamic_ppg": 20.0,
    "low_ratio": 0.8, "uncorrelated": 0.1, "valid_ibi_fail": 80.0, "valid_ibi": 90.0, "good_fail": 60.0, "good": 80.0, "hr_low": 40.0, "hr_high": 180.0,
    "cv_fail": 20.0, "cv": 5.0, "coupling_fail": 0.5, "coupling": 0.75, "interval_ms": 1500.0, "duration": 840.0, "global_fail": 30.0, "global": 10.0, "imbalance": 10.0,
}
#: Measures of a signal that the decision looks at; one that is null or absent never speaks against it.
MEASURES = ("missing_percent", "clipping_percent", "flatline_seconds", "artifact_percent", "amplitude_bad_percent", "dynamic_ratio", "low_ratio", "channel_correlation", "valid_ibi_percent", "good_percent", "median_hr_bpm", "raw_cv_percent", "coupling_index")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def signal_decisions(measures: DataFrame, modality: Column, limits: dict[str, float] | None = None) -> DataFrame:
    """Add label and reasons (`;` between them) to rows of measures, by the rules of their modality: EEG, PPG or fNIRS."""
    at = LIMITS | (limits or {})
    d = measures.withColumns({m: F.lit(None).cast("double") for m in MEASURES if m not in measures.columns})
    m, x = modality, lambda name: F.col(name)
    structural = _is((x("missing_percent") > at["missing"]) | (x("clipping_percent") > at["clipping"]) | (x("flatline_seconds") > at["flatline"]))
    eeg, ppg = m == "EEG", m == "PPG"
    severe = _is((x("artifact_percent") > at["artifact_severe"]) | (x("amplitude_bad_percent") > at["artifact_severe"]))
    moderate = _is((x("artifact_percent") > at["artifact_moderate"]) | (x("amplitude_bad_percent") > at["artifact_moderate"]) | (x("dynamic_ratio") > at["dynamic_eeg"]))
    dominated = _is((x("low_ratio") > at["low_ratio"]) & (x("channel_correlation") < at["uncorrelated"]))
    no_pulse = _is((x("valid_ibi_percent") < at["valid_ibi_fail"]) | (x("good_percent") < at["good_fail"]) | (x("dynamic_ratio") > at["dynamic_ppg_fail"]))
    odd_rate = _is((x("median_hr_bpm") < at["hr_low"]) | (x("median_hr_bpm") > at["hr_high"]))
    weak_pulse = _is((x("valid_ibi_percent") < at["valid_ibi"]) | (x("good_percent") < at["good"]) | (x("dynamic_ratio") > at["dynamic_ppg"]))
    poor, marginal = _is(x("coupling_index") < at["coupling_fail"]), _is((x("coupling_index") >= at["coupling_fail"]) & (x("coupling_index") < at["coupling"]))
    unstable = _is((x("artifact_percent") > at["artifact_severe"]) | (x("raw_cv_percent") > at["cv_fail"])) | poor
    shaky = _is((x("artifact_percent") > at["artifact_moderate"]) | (x("raw_cv_percent") > at["cv"])) | marginal
    failed = F.when(eeg, structural | severe).when(ppg, structural | no_pulse | odd_rate).otherwise(structural | unstable)
    held = F.when(eeg, moderate | dominated).when(ppg, weak_pulse).otherwise(shaky)
    reasons = distinct_reasons(
        F.when(structural, "structural_signal_failure"), F.when(eeg & severe, "severe_recurrent_artifact"), F.when(eeg & ~failed & moderate, "moderate_artifact_burden"), F.when(eeg & ~failed & dominated, "low_frequency_dominance_uncorrelated"),
        F.when(ppg & no_pulse, "poor_pulse_detectability"), F.when(ppg & odd_rate, "implausible_median_heart_rate"), F.when(ppg & ~failed & weak_pulse, "moderate_ppg_artifact"),
        F.when(~eeg & ~ppg & ~structural & unstable, F.when(poor, "poor_scalp_coupling").otherwise("severe_optical_instability")), F.when(~eeg & ~ppg & ~failed & shaky, F.when(marginal, "marginal_scalp_coupling").otherwise("moderate_optical_instability")),
    )
    fine = F.when(eeg, "acceptable_qc_metrics").when(ppg, "stable_pulse_waveform").otherwise("stable_raw_optical_intensity")
    label = F.when(failed, "FAIL").when(held, "CONDITIONAL_PASS").otherwise("PASS")
    d = d.withColumn("label", label).withColumn("reasons", F.when(reasons == "", fine).otherwise(reasons))
    return d.select(*measures.columns, "label", "reasons")


def session_decisions(signals: DataFrame, recordings: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row for each session of recordings: the labels of recording, EEG, PPG and fNIRS, the overall one, status and reasons.

    signals: session_id, signal (AF3, AF4, PPG, fNIRS_1, fNIRS_2), label. recordings: session_id, duration_seconds, long_intervals,
    duplicates, global_artifact_percent, rms_ratio. A session without windows counts as all artifact. A signal that is not
    there is NOT_ASSESSABLE, which is not a pass; either EEG channel or both optical ones have to fail to fail a modality.
    """
    at = LIMITS | (limits or {})
    label = lambda s: F.coalesce(F.max(F.when(F.col("signal") == s, F.col("label"))), F.lit("NOT_ASSESSABLE")).alias(s)
    none = F.lit("NOT_ASSESSABLE")
    s = recordings.join(signals.groupBy("session_id").agg(*[label(x) for x in ("AF3", "AF4", "PPG", "fNIRS_1", "fNIRS_2")]), "session_id", "left")
    a, b, p, x, y = (F.coalesce(c, none) for c in ("AF3", "AF4", "PPG", "fNIRS_1", "fNIRS_2"))
    share = F.coalesce("global_artifact_percent", F.lit(100.0))
    short, gaps, twice = _is(F.col("duration_seconds") < at["duration"]), _is(F.col("long_intervals") > 0), _is(F.col("duplicates") > 0)
    either = lambda v, w, what: (v == what) | (w == what)
    eeg = F.when(either(a, b, "FAIL"), "FAIL").when(either(a, b, "NOT_ASSESSABLE"), "NOT_ASSESSABLE").when(either(a, b, "CONDITIONAL_PASS"), "CONDITIONAL_PASS").otherwise("PASS")
    fnirs = F.when((x == "FAIL") & (y == "FAIL"), "FAIL").when((x == "NOT_ASSESSABLE") & (y == "NOT_ASSESSABLE"), "NOT_ASSESSABLE").when((x == "PASS") & (y == "PASS"), "PASS").otherwise("CONDITIONAL_PASS")
    s = s.select("session_id", F.when(short, "FAIL").when(gaps | twice, "CONDITIONAL_PASS").otherwise("PASS").alias("recording_label"), eeg.alias("eeg_label"), p.alias("ppg_label"), fnirs.alias("fnirs_raw_label"), F.lit("NOT_ASSESSABLE").alias("fnirs_hbo_hbr_readiness"), share.alias("global_multimodal_artifact_percent"), short.alias("_short"), gaps.alias("_gaps"), twice.alias("_twice"), _is(F.col("rms_ratio") > at["imbalance"]).alias("_uneven"))
    c, share = F.col, F.col("global_multimodal_artifact_percent")
    both = (c("eeg_label") == "FAIL") & (c("ppg_label") == "FAIL")
    partial = (c("recording_label") != "PASS") | (c("eeg_label") != "PASS") | (c("ppg_label") != "PASS") | (c("fnirs_raw_label") != "PASS") | (share > at["global"])
    why = F.when(c("_short"), F.lit(None)).when(both, "eeg_and_ppg_failed").when(share > at["global_fail"], "severe_multimodal_artifact").when(partial, "usable_after_cleaning_or_partial_modality_limit").otherwise("all_primary_qc_layers_passed")
    first = F.when(c("_short") | both | (share > at["global_fail"]), "FAIL").when(partial, "CONDITIONAL_PASS").otherwise("PASS")
    s = s.withColumn("_first", first).withColumn("overall_session_label", F.when((c("_first") != "FAIL") & c("_uneven"), "CONDITIONAL_PASS").otherwise(c("_first")))
    status = F.when(c("overall_session_label") == "PASS", "included").when(c("overall_session_label") == "CONDITIONAL_PASS", "included_after_cleaning").otherwise("excluded_from_primary_analysis")
    reasons = distinct_reasons(F.when(c("_short"), "longest_continuous_block_below_minimum"), F.when(c("_gaps"), "packet_gaps_detected"), F.when(c("_twice"), "duplicate_packet_timestamps"), why, F.when((c("_first") != "FAIL") & c("_uneven"), "large_eeg_channel_imbalance"))
    return s.withColumn("analysis_status", status).withColumn("reasons", reasons).drop("_short", "_gaps", "_twice", "_uneven", "_first")
