"""Recordings in and out: device CSV, EDF, session folders, event tables, and the files that go with results."""

from __future__ import annotations

import base64
import io
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a packet (one second), and how many of them hold optical samples.
PACKET, OPTICAL = 244, 100
#: Names that a device's columns go by; the first that is there counts.
ALIASES = {
    "timestamp": ("timestamp", "Timestamp", "time"),
    "af3": ("AF_3", "AF3", "af3"),
    "af4": ("AF_4", "AF4", "af4"),
    "ppg": ("PPG", "ppg"),
    "fnirs_1": ("Fnir_1", "fNIRS_1", "fnirs_1"),
    "fnirs_2": ("Fnir_2", "fNIRS_2", "fnirs_2"),
}


def resolve_columns(columns: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """Which column plays each role; ValueError names the roles that none does."""
    found = {role: next((n for n in names if n in columns), None) for role, names in aliases.items()}
    if missing := sorted(k for k, v in found.items() if v is None):
        raise ValueError(f"no column for {', '.join(missing)} among {columns}")
    return found


def numeric(column: Column | str) -> Column:
    """A number or null: what does not parse, is not a number or is infinite is missing."""
    x = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def identity(path: Column) -> dict[str, Column]:
    """participant_key, study_day and session_id from `name=value` parts of a path; `unknown`, or null for a day without digits."""
    part = lambda name: F.regexp_extract(path, rf"{name}=([^/\\]+)", 1)
    known = lambda c: F.when(c != "", c).otherwise("unknown")
    return {"participant_key": known(part("participant")), "study_day": F.when(part("study_day").rlike(r"^\d+$"), part("study_day").try_cast("int")), "session_id": known(part("session_id"))}


def read_device_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all recordings under a path: identity, file, row_idx within the file, packet_id, and a number per role.

    Files are read in splits; a row's place is its rank by split and position, one window per file.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    roles = resolve_columns(raw.columns)
    d = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"), *[numeric(F.col(f"`{c}`")).alias(role) for role, c in roles.items()])
    d = d.withColumn("row_idx", (F.row_number().over(Window.partitionBy("file").orderBy("_id")) - 1).cast("long")).withColumn("packet_id", F.floor(F.col("row_idx") / PACKET))
    return d.withColumns(identity(F.col("file"))).drop("_id")


def numbered(rows: DataFrame, order: Iterable[str], row_idx: str = "row_idx") -> tuple[DataFrame, int]:
    """The rows with their place from 0 in this order, and their number: sorted by ranges, each with the rows before it added.

    The sorted rows are kept by executors, since the ranges' sizes and the rows have to be of one and the same sort.
    """
    d = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).persist()
    sizes = sorted(d.groupBy(F.shiftright("_id", 33).alias("part")).count().collect())
    starts, total = [], 0
    for r in sizes:
        starts.append((r[0], total))
        total += r[1]
    before = d.sparkSession.createDataFrame(starts, "_part long, _start long")
    d = d.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")  # one row a range on the right
    return d.withColumn(row_idx, F.col("_start") + F.col("_id") % (1 << 33)).drop("_id", "_part", "_start"), total


def unpack_optical(rows: DataFrame, keys: Iterable[str], row_idx: str = "row_idx", packet: int = PACKET, optical: int = OPTICAL, n: Column | None = None) -> DataFrame:
    """The rows that hold optical samples, of whole packets only, with their place as sample_idx.

    n is the number of rows of a row's recording where it is known; else it is looked up by a window per recording.
    """
    n = F.max(row_idx).over(Window.partitionBy(*keys)) + 1 if n is None else n
    d = rows.withColumn("_n", n).withColumn("_p", F.floor(F.col(row_idx) / packet)).withColumn("_o", F.col(row_idx) % packet)
    d = d.filter((F.col("_o") < optical) & (F.col("_p") < F.floor(F.col("_n") / packet)))
    return d.withColumn("sample_idx", F.col("_p") * optical + F.col("_o")).drop("_n", "_p", "_o")


def file_identity(path: Column) -> dict[str, Column]:
    """participant_key, study_day and session_id_short from a file name <participant>_day<number>_<hex>.fif; null where it has none."""
    name = F.regexp_extract(path, r"([^/\\\\]*)$", 1)
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {"participant_key": part("^(.+?)_day"), "study_day": part(r"_day(\d+)_").cast("int"), "session_id_short": part(r"_day\d+_([0-9a-f]+)\.fif$")}


def block_rows(rows: DataFrame, keys: list[str], first_packet: int, last_packet: int, packet: int = PACKET) -> DataFrame:
    """The rows of the packets first to last, both included, with row_idx and packet_id counted from 0 again."""
    d = rows.filter(F.col("packet_id").between(first_packet, last_packet))
    return d.select(*keys, *[c for c in d.columns if c not in (*keys, "row_idx", "packet_id")], (F.col("row_idx") - first_packet * packet).alias("row_idx"), (F.col("packet_id") - first_packet).alias("packet_id"))


def optical_table(rows: DataFrame, keys: list[str], fs: float = 100.0) -> DataFrame:
    """Device rows as an optical table: sample_index, time_seconds, packet_timestamp (that of the packet's first row),
    fnirs_1_raw and fnirs_2_raw, whole packets only."""
    d = unpack_optical(rows, keys)
    stamp = F.first("timestamp").over(Window.partitionBy(*keys, "packet_id").orderBy("row_idx"))
    return d.select(*keys, F.col("sample_idx").alias("sample_index"), (F.col("sample_idx") / fs).alias("time_seconds"), stamp.alias("packet_timestamp"), F.col("fnirs_1").alias("fnirs_1_raw"), F.col("fnirs_2").alias("fnirs_2_raw"))


def read_optical(spark: SparkSession, path: str, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (file, sample_idx, the columns as numbers) of all files called `name` under a path, and one row for each file
    with its flag: EMPTY_FILE without rows below the header, INVALID_COLUMNS where the header lacks one, null else.

    Each file is read by its own header, so files may hold other columns, in any order. Fields are numbers: no quotes.
    Spark lists no files of zero bytes; they count as missing.
    """
    at = F.col("_metadata.file_path").alias("file")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path).select(at, F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\s+$", "").alias("_line"))
    head = lines.groupBy("file").agg(F.min("_id").alias("_first"), F.min_by("_line", "_id").alias("_head"), (F.count_if(F.col("_line") != "") - 1).alias("_rows"))
    names = F.transform(F.split("_head", ","), lambda x: F.trim(x))
    head = head.withColumn("_names", names).withColumn("_ok", F.size(F.array_except(F.array(*[F.lit(c) for c in columns]), "_names")) == 0)
    flags = head.select("file", F.when(F.col("_rows") <= 0, "EMPTY_FILE").when(~F.col("_ok"), "INVALID_COLUMNS").alias("flag"))
    fields = F.split("_line", ",")
    d = lines.join(head.filter("_ok"), "file").filter((F.col("_id") > F.col("_first")) & (F.col("_line") != ""))
    value = lambda c: numeric(F.get(fields, F.array_position("_names", c).cast("int") - 1)).alias(c)
    d = d.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("_id")) - 1).cast("long").alias("sample_idx"), *[value(c) for c in columns])
    return d, flags


def read_optical_sessions(spark: SparkSession, path: str, raw: str = "fnirs_raw.csv", fallback: str = "fnirs_hbo_hbr.csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intensities, concentrations, sessions): a session is a folder, and its raw table is taken before its concentrations.

    intensities hold folder, sample_idx, time_seconds, i740, i850; concentrations hbo and hbr instead, for sessions without a
    raw table that can be read. sessions say which stage each one has (null for none) and the flags of its files, MISSING_FILE
    among them.
    """
    folder = F.regexp_replace("file", r"/[^/]*$", "").alias("folder")
    (a, fa), (b, fb) = read_optical(spark, path, ["time_seconds", "fnirs_1_raw", "fnirs_2_raw"], raw), read_optical(spark, path, ["time_seconds", "HbO_uM", "HbR_uM"], fallback)
    seen = lambda f, kind: f.select(folder, F.lit(True).alias(f"_{kind}"), F.col("flag").alias(f"_{kind}_flag"))
    s = seen(fa, "raw").join(seen(fb, "conc"), "folder", "full")
    good = lambda kind: F.coalesce(F.col(f"_{kind}") & F.col(f"_{kind}_flag").isNull(), F.lit(False))
    s = s.withColumn("input_signal_stage", F.when(good("raw"), "raw_intensity").when(good("conc"), "concentration_fallback"))
    missing = lambda kind: F.when(F.col(f"_{kind}").isNull(), "MISSING_FILE").otherwise(F.col(f"_{kind}_flag"))
    flags = F.array_distinct(F.array_compact(F.array(missing("raw"), F.when(~good("raw"), missing("conc")))))
    sessions = s.select("folder", "input_signal_stage", F.array_join(flags, ";").alias("input_qc_flags"))
    second = sessions.filter("input_signal_stage = 'concentration_fallback'").select("folder")
    x = a.select(folder, "sample_idx", "time_seconds", F.col("fnirs_1_raw").alias("i740"), F.col("fnirs_2_raw").alias("i850"))
    y = b.select(folder, "sample_idx", "time_seconds", F.col("HbO_uM").alias("hbo"), F.col("HbR_uM").alias("hbr")).join(second, "folder", "left_semi")
    return x, y, sessions


def load_errors(samples: DataFrame, key: str, signal: str = "signal", fs: str | None = None) -> DataFrame:
    """(key, error_type, message) of recordings that cannot be worked on: without a signal, without a number, or with a rate
    that is not above 0. One aggregate; rows for the table of errors."""
    g = samples.groupBy(key).agg(F.count(signal).alias("_signals"), F.count(F.when(~F.isnan("value") & (F.abs("value") < float("inf")), 1)).alias("_numbers"), (F.min(fs) if fs else F.lit(1.0)).alias("_fs"))
    message = F.when(F.col("_signals") == 0, "no channel").when(F.coalesce(F.col("_fs"), F.lit(0.0)) <= 0, "sampling rate is not above 0").when(F.col("_numbers") == 0, "no finite sample")
    return g.select(key, F.lit("LoadFail").alias("error_type"), message.alias("message")).filter("message IS NOT NULL")


def read_matrices(spark: SparkSession, path: str, fs: float) -> DataFrame:
    """file, signal (E1, E2, ...), fs, sample_idx, value, error of every .npy file under a path.

    Rows are channels; a matrix with more rows than columns is turned. What is not a matrix of numbers gives one row with its
    error. One file is one task's work: a matrix has no parts that can be read alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    x = np.load(io.BytesIO(bytes(content)), allow_pickle=False).astype(float)
                    if x.ndim != 2:
                        raise ValueError(f"{x.ndim} dimensions instead of 2")
                except (ValueError, TypeError, EOFError) as e:
                    yield pd.DataFrame({"file": [name], "signal": [None], "fs": [None], "sample_idx": pd.array([None], "Int64"), "value": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                for i, row in enumerate(x.T if x.shape[0] > x.shape[1] else x):
                    yield pd.DataFrame({"file": name, "signal": f"E{i + 1}", "fs": float(fs), "sample_idx": np.arange(len(row)), "value": row, "error": None})

    return files.mapInPandas(decode, "file string, signal string, fs double, sample_idx long, value double, error string")


def edf_durations(spark: SparkSession, path: str) -> DataFrame:
    """file and seconds of every EDF file, from two fields of its header; null where they are no numbers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.edf").load(path)
    field = lambda start: numeric(F.trim(F.substring(F.col("content"), start, 8).cast("string")))
    return files.select(F.col("path").alias("file"), (field(237) * field(245)).alias("seconds"))


def block_times(timestamp: Column) -> Column:
    """A number as a time: milliseconds over 1e10, seconds over 1e9, else null."""
    return F.when(timestamp > 1e10, F.timestamp_millis(timestamp.cast("long"))).when(timestamp > 1e9, F.timestamp_seconds(timestamp))


def read_events(spark: SparkSession, path: str, clock: float = 244.0, name: str = "*") -> DataFrame:
    """Protocol events in seconds, of the files called `name` (a pattern): file, event_order, start_s, duration_s, description."""
    columns = "latency string, duration_samples string, description string"
    try:
        raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(path)
    except AnalysisException:  # no file of that name
        raw = spark.createDataFrame([], columns + ", _metadata struct<file_path: string>")
    d = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("event_order"), numeric("latency").alias("_l"), numeric("duration_samples").alias("_d"), F.col("description"))
    return d.select("file", "event_order", (F.col("_l") / clock).alias("start_s"), (F.col("_d") / clock).alias("duration_s"), "description")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, bytes and SHA-256 of each file under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def quality_flags(rows: DataFrame, *, length: str = "File_Length_s", kept: str = "Pct_Var_Retained_PostWavelet", shortest: float = 700.0, longest: float = 1100.0, least_kept: float = 10.0, prefix: str = "") -> DataFrame:
    """Add eeg_quality_flags and eeg_quality_pass. A missing figure sets no flag: missing is not failed. No row goes."""
    n, v = F.col(length), F.col(kept)
    fired = {"TRUNCATED_RECORDING": n < shortest, "ANOMALOUS_LONG_RECORDING": n > longest, "LOW_VARIANCE_RETAINED": v < least_kept}
    flags = F.concat_ws(";", *[F.when(c, F.lit(prefix + name)) for name, c in fired.items()])
    return rows.withColumn("eeg_quality_flags", flags).withColumn("eeg_quality_pass", F.col("eeg_quality_flags") == "")


# --- EDF ---------------------------------------------------------------------------------------------------------------


def _limits(x: np.ndarray) -> tuple[float, float]:
    lo, hi = float(x.min()), float(x.max())
    pad = (hi - lo) * 0.01 or max(abs(lo) * 0.01, 1.0)
    return lo - pad, hi + pad


def encode_edf(signals: dict[str, np.ndarray], fs: int, unit: str = "uV", start: str = "01.01.8500.00.00") -> bytes:
    """One-second records of 16-bit samples; a last, partial second is left out."""
    names, n = list(signals), min(len(x) for x in signals.values()) // fs
    field = lambda v, w: str(v)[:w].ljust(w).encode("ascii")
    head = field("0", 8) + field("X", 80) + field("X", 80) + field(start[:8], 8) + field(start[8:], 8) + field(256 * (len(names) + 1), 8) + field("", 44) + field(n, 8) + field(1, 8) + field(len(names), 4)
    limits = [[float(f"{v:.6g}"[:8]) for v in _limits(np.asarray(x[: n * fs] if n else x, float))] for x in signals.values()]
    per = [[f(i) for i in range(len(names))] for f in (lambda i: field(names[i], 16), lambda i: field("", 80), lambda i: field(unit, 8), lambda i: field(limits[i][0], 8), lambda i: field(limits[i][1], 8), lambda i: field(-32767, 8), lambda i: field(32767, 8), lambda i: field("", 80), lambda i: field(fs, 8), lambda i: field("", 32))]
    head += b"".join(b"".join(p) for p in per)
    digital = [np.clip(np.round((np.asarray(x[: n * fs], float) - lo) / (hi - lo) * 65534 - 32767), -32767, 32767).astype("<i2").reshape(n, fs) for x, (lo, hi) in zip(signals.values(), limits, strict=True)]
    return head + (np.concatenate(digital, axis=1).tobytes() if n else b"")


def decode_edf(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Signals in physical units by label, and each one's sampling rate."""
    if len(data) < 256:
        raise ValueError("not an EDF file")
    n, seconds, count = int(data[236:244]), float(data[244:252]), int(data[252:256])
    at, out = 256, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        out.append([data[at + i * width : at + (i + 1) * width].decode("ascii").strip() for i in range(count)])
        at += width * count
    label, (plo, phi, dlo, dhi), size = out[0], ([float(v) for v in out[k]] for k in (3, 4, 5, 6)), [int(v) for v in out[8]]
    raw = np.frombuffer(data, "<i2", n * sum(size), at).reshape(n, sum(size)).astype(float)
    begin = np.concatenate([[0], np.cumsum(size)])
    signals = {label[i]: (raw[:, begin[i] : begin[i + 1]].ravel() - dlo[i]) / (dhi[i] - dlo[i]) * (phi[i] - plo[i]) + plo[i] for i in range(count)}
    return signals, {label[i]: size[i] / seconds for i in range(count)}


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """file, signal, fs, sample_idx, value of every EDF file under a path; a file that does not parse gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.edf").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                try:
                    signals, rates = decode_edf(bytes(content))
                except (ValueError, IndexError, struct.error) as e:
                    yield pd.DataFrame({"file": [name], "signal": [None], "fs": [None], "sample_idx": pd.array([None], "Int64"), "value": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                for signal, x in signals.items():
                    yield pd.DataFrame({"file": name, "signal": signal, "fs": rates[signal], "sample_idx": np.arange(len(x)), "value": x, "error": None})

    return files.mapInPandas(decode, "file string, signal string, fs double, sample_idx long, value double, error string")


def edf_files(samples: DataFrame, key: str, fs: int) -> DataFrame:
    """key and the bytes of an EDF file of its signals: one task holds one recording."""
    kind = dict(samples.dtypes)[key]

    def encode(k, rows):
        signals = {s: g.sort_values("sample_idx").value.to_numpy(float) for s, g in rows.groupby("signal")}
        return pd.DataFrame({key: [k[0]], "content": [encode_edf(signals, fs)]})

    return samples.select(key, "signal", "sample_idx", "value").groupBy(key).applyInPandas(encode, f"{key} {kind}, content binary")


def sidecar(samples: DataFrame, key: str, fs: float) -> DataFrame:
    """key and a JSON text: rate, number of samples, and each signal's samples as base64 of 32-bit floats."""
    kind = dict(samples.dtypes)[key]

    def pack(k, rows):
        x = rows.sort_values("sample_idx").value.to_numpy(np.float32)
        return pd.DataFrame({key: [k[0]], "signal": [k[1]], "n": [len(x)], "data": [base64.b64encode(x.tobytes()).decode()]})

    parts = samples.select(key, "signal", "sample_idx", "value").groupBy(key, "signal").applyInPandas(pack, f"{key} {kind}, signal string, n long, data string")
    whole = parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "data")))).alias("channels"), F.max("n").alias("n_samples"))
    return whole.select(key, F.to_json(F.struct(F.lit(float(fs)).alias("sfreq"), "n_samples", "channels")).alias("json"))


def write_tables(tables: dict[str, DataFrame], folder: str, partition: dict[str, list[str]] | None = None) -> None:
    """Each table as Parquet under its name. An empty error log is written too."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition or {}).get(name, [])).parquet(f"{folder}/{name}")
