"""Study and participant tables: session masters, summaries, roster, review flags, tiers, tests and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INCLUDED = ("INCLUDED", "INCLUDED_CONDITIONAL")


def final_label(eligible: Column, overall: Column, reasons: Column) -> Column:
    """What becomes of a session: first eligibility, then the quality label and why it failed."""
    short = F.coalesce(reasons, F.lit("")).contains("longest_continuous_block_below_minimum")
    failed = F.when(short, "EXCLUDED_L2_DURATION").otherwise("EXCLUDED_L2_SIGNAL")
    return (
        F.when(eligible == False, "EXCLUDED_L1").when(overall.isNull(), "L2_NOT_RUN").when(overall == "FAIL", failed)  # noqa: E712
        .when(overall == "CONDITIONAL_PASS", "INCLUDED_CONDITIONAL").when(overall == "PASS", "INCLUDED").otherwise("UNKNOWN")
    )


def pivot_quality(rows: DataFrame, session: str, signal: str, signals: list, metrics: list[str], order: Column) -> DataFrame:
    """One row per session with signal_metric columns; of rows that repeat a signal the last in order counts."""
    last = [F.max_by(m, order).alias(m) for m in metrics]
    return rows.groupBy(session).pivot(signal, signals).agg(*last)


def master_sessions(sessions: DataFrame, quality: DataFrame) -> DataFrame:
    """sessions, with quality on the left join of session_id, and final_label. Sessions without quality stay."""
    m = sessions.join(quality, "session_id", "left")
    return m.withColumn("final_label", final_label(F.col("analysis_eligible"), F.col("overall_label"), F.col("reasons")))


def participant_summary(master: DataFrame) -> DataFrame:
    """One row per participant: counts, days, yield, failure rate of primary sessions, days covered and missing."""
    primary, included = F.col("session_role") == "primary_valid", F.col("final_label").isin(*INCLUDED)
    s = master.groupBy("participant_key").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_if(primary).alias("primary_valid_sessions"), F.count_if(F.col("session_role") == "invalid_attempt").alias("invalid_attempt_sessions"),
        F.count_distinct(F.when(primary, F.col("study_day"))).alias("days_attempted"), F.count_distinct(F.when(included, F.col("study_day"))).alias("days_included"),
        F.count_distinct(F.when(F.col("final_label") == "INCLUDED", F.col("study_day"))).alias("days_pass_only"),
        (F.avg(F.when(primary, (F.col("overall_label") == "FAIL").cast("double"))) * 100).alias("fail_rate_percent"),
        F.count_if(F.col("final_label").isin("EXCLUDED_L2_SIGNAL", "EXCLUDED_L2_DURATION")).alias("any_excluded_l2"),
        F.array_sort(F.collect_set("study_day")).alias("study_days_covered"),
    )
    s = s.withColumn("yield_percent", F.when(F.col("days_attempted") > 0, F.bround(F.col("days_included") / F.col("days_attempted") * 100, 1)))
    days = F.sequence(F.array_min("study_days_covered"), F.array_max("study_days_covered"))
    none = F.array().cast(dict(s.dtypes)["study_days_covered"])
    return s.withColumn("missing_days", F.when(F.col("days_attempted") > 0, F.array_except(days, F.col("study_days_covered"))).otherwise(none))


#: The label columns of the modalities, and what their failure rates are called.
FAIL_RATES = {"eeg_label": "eeg_fail_rate_percent", "ppg_label": "ppg_fail_rate_percent", "fnirs_raw_label": "fnirs_fail_rate_percent"}


def participant_report(master: DataFrame, name: str = "participant_name", group: str = "group_name") -> DataFrame:
    """participant_summary with the name of the first session (by study_day, then session_id), the most frequent group (the least
    of ties), and the failure rate of primary sessions by modality. A column that master lacks gives nulls; a label that is
    null counts as no failure; participants without primary sessions have no rates. Two aggregates by participant, one join.
    """
    primary, at = F.col("session_role") == "primary_valid", F.struct("study_day", "session_id")
    none = lambda kind: F.first(F.lit(None).cast(kind))
    rate = lambda c: F.avg(F.when(primary, F.coalesce(F.col(c) == "FAIL", F.lit(False)).cast("double"))) * 100
    more = master.groupBy("participant_key").agg(
        (F.min_by(name, at) if name in master.columns else none("string")).alias("participant_name"),
        (F.mode(group, deterministic=True) if group in master.columns else none("string")).alias("group_name"),
        *[(rate(c) if c in master.columns else none("double")).alias(out) for c, out in FAIL_RATES.items()],
    )
    summary = participant_summary(master)
    joined = summary.withColumnRenamed("participant_key", "_key").join(more, F.col("_key").eqNullSafe(F.col("participant_key")))
    return joined.select("participant_key", "participant_name", "group_name", *[c for c in summary.columns if c != "participant_key"], *FAIL_RATES.values())


def with_identity(quality: DataFrame, identities: DataFrame, file: str = "File") -> DataFrame:
    """quality with participant_key, study_day and session_id of its file in front (null for files nobody knows); no row is lost,
    and a file that identities name more than once takes its least identity."""
    names = ["participant_key", "study_day", "session_id"]
    one = identities.groupBy(file).agg(F.min(F.struct(*names)).alias("_i")).select(file, "_i.*")
    return quality.drop(*names).join(one, file, "left").select(*names, file, *[c for c in quality.columns if c not in (*names, file)])


def participant_medians(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, median_<column>): medians by participant over the values that are there."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(f"median_{c}") for c in columns])


def session_folders(wanted: DataFrame, sessions: DataFrame, root: str) -> DataFrame:
    """wanted (participant_key, study_day) with the session_id and folder of that day, days in two digits; null for none. Of
    several sessions of a day the last one counts, as in a lookup that later entries replace."""
    keys = ["participant_key", "study_day"]
    last = sessions.groupBy(*keys).agg(F.max("session_id").alias("session_id"))
    day = F.lpad(F.col("study_day").cast("string"), 2, "0")
    folder = F.concat_ws("/", F.lit(root), F.concat(F.lit("participant="), "participant_key"), F.concat(F.lit("study_day="), F.when(F.col("study_day") > 99, F.col("study_day").cast("string")).otherwise(day)), F.concat(F.lit("session_id="), F.col("session_id").cast("string")))
    return wanted.join(last, keys, "left").withColumn("folder", F.when(F.col("session_id").isNotNull(), folder))


def study_day_summary(master: DataFrame) -> DataFrame:
    primary = F.col("session_role") == "primary_valid"
    rate = lambda label: (F.avg(F.when(primary, (F.col("overall_label") == label).cast("double"))) * 100)
    return master.groupBy("study_day").agg(F.count(F.lit(1)).alias("total_sessions"), F.count_distinct("participant_key").alias("n_participants"), F.count_if(F.col("final_label").isin(*INCLUDED)).alias("n_included"), rate("FAIL").alias("fail_rate_percent"), rate("PASS").alias("pass_rate_percent"))


def roster(master: DataFrame, least_days: int, strict: bool = False) -> DataFrame:
    """Included sessions of participants with at least least_days included days."""
    ok = master.filter(F.col("final_label").isin(*(INCLUDED[:1] if strict else INCLUDED)))
    days = ok.groupBy("participant_key").agg(F.count_distinct("study_day").alias("_n")).filter(F.col("_n") >= least_days)
    return ok.join(days, "participant_key", "left_semi")


def review_flags(master: DataFrame, summary: DataFrame) -> DataFrame:
    """flag_type, priority, participant_key, study_day, session_id, detail; distinct rows of all kinds."""
    row = lambda d, kind, priority, day, session, detail: d.select(F.lit(kind).alias("flag_type"), F.lit(priority).alias("priority"), "participant_key", day.cast("int").alias("study_day"), session.cast("long").alias("session_id"), detail.alias("detail"))
    day, session, none = F.col("study_day"), F.col("session_id"), F.lit(None)
    failed = [row(master.filter(F.col("final_label") == k), k, p, day, session, F.coalesce("reasons", F.lit(""))) for k, p in (("EXCLUDED_L2_SIGNAL", "HIGH"), ("EXCLUDED_L2_DURATION", "LOW"))]
    by_day = Window.partitionBy("participant_key").orderBy("study_day", "session_id")
    out = F.col("final_label").isin("EXCLUDED_L1", "EXCLUDED_L2_DURATION", "EXCLUDED_L2_SIGNAL")
    pair = master.filter("study_day IS NOT NULL").withColumn("_x", out).withColumn("_next", F.lead("_x").over(by_day)).withColumn("_d", F.lead("study_day").over(by_day)).filter("_x AND _next")
    pair = pair.groupBy("participant_key").agg(F.min_by(F.struct("study_day", F.col("_d")), F.struct("study_day", "session_id")).alias("p"))
    text = F.format_string("Day %d and %d both excluded", F.col("p.study_day"), F.col("p._d"))
    consecutive = row(pair.withColumn("study_day", F.col("p.study_day")), "CONSECUTIVE_EXCLUSIONS", "HIGH", day, none, text)
    gaps = summary.filter(F.size("missing_days") > 0)
    missing = row(gaps, "MISSING_DAYS", "MEDIUM", none, none, F.concat(F.lit("Missing days: ["), F.array_join(F.col("missing_days").cast("array<string>"), ", "), F.lit("]")))
    union = failed[0]
    for d in (failed[1], consecutive, missing):
        union = union.unionByName(d)
    for c, kind, bad, pattern in (("fnirs_raw_correlation", "LOW_FNIRS_CORRELATION", lambda x: x < 0.5, "fNIRS corr = %.3f"), ("eeg_rms_ratio", "EEG_CHANNEL_IMBALANCE", lambda x: x > 10, "EEG RMS ratio = %.1f")):
        if c in master.columns:
            union = union.unionByName(row(master.filter(bad(F.col(c))), kind, "MEDIUM", day, session, F.format_string(pattern, F.col(c))))
    return union.distinct()


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row in order, in one aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")).select(key, "_l.*")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation of x and y within keys, average ranks for ties; null with fewer than least pairs or no spread."""
    d = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        d = d.withColumn(f"_r{c}", F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (ties - 1) / 2)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.covar_pop(f"_r{x}", f"_r{y}").alias("_c"), F.stddev_pop(f"_r{x}").alias("_a"), F.stddev_pop(f"_r{y}").alias("_b"))
    return g.select(*keys, "n_pairs", F.when((F.col("n_pairs") >= least) & (F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / (F.col("_a") * F.col("_b"))).alias("rho"))


def composite(rows: DataFrame, columns: list[str], signs: dict[str, int], least: int) -> DataFrame:
    """Add composite: the mean of signed z scores (population sd over all rows), null with fewer than least of them.

    Means and deviations are one global aggregate of a row, joined back by a broadcast of that row.
    """
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    d = rows.crossJoin(F.broadcast(stats))  # one row on the right
    z = F.array_compact(F.array(*[F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") * signs.get(c, 1)) for c in columns]))
    d = d.withColumn("_z", z).withColumn("composite", F.when(F.size("_z") >= least, F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / F.size("_z")))
    return d.select(*rows.columns, "composite")


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Add q (adjusted p) and significant within each family of tests."""
    w = Window.partitionBy(*family)
    d = tests.withColumn("_n", F.count(p).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p)))
    d = d.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))))
    return d.withColumn("significant", F.col("q") <= alpha).drop("_n", "_r")


def theil_sen(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median slope of all pairs of points of a key and its intercept. For binned points: a few per key."""
    other = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = rows.join(other, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(x) < F.col("_x")])
    slope = pairs.groupBy(*keys).agg(F.median((F.col("_y") - F.col(y)) / (F.col("_x") - F.col(x))).alias("slope"))
    mid = rows.groupBy(*keys).agg(F.median(x).alias("_mx"), F.median(y).alias("_my"))
    return slope.join(mid, keys).select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))
