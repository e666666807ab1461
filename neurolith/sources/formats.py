"""Recordings' files as Spark data sources: EDF and BDF by ranges of their records, matrices by file; text and MAT files out.

`register(spark)` makes the formats `neurolith_recordings` (reader) and `neurolith_matrices` (writer) known to a session.
Files are reached through Arrow's file systems, so a path may be a URI of any store that Arrow knows, or a shared folder.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, signal string, fs double, sample_idx long, value double, error string"
#: How a file is read, by its suffix.
FORMATS = {".edf": "edf", ".bdf": "bdf", ".npy": "npy", ".mat": "mat"}


def store(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


# --- MAT files, level 5 ------------------------------------------------------------------------------------------------

# Element types and array classes of the format.
_NUMBERS = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
_MATRIX, _COMPRESSED, _CELL, _CHAR, _DOUBLE = 14, 15, 1, 4, 6


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _array(name: str, of: int, dims: tuple[int, ...], body: bytes) -> bytes:
    return _element(_MATRIX, _element(6, struct.pack("<II", of, 0)) + _element(5, struct.pack(f"<{len(dims)}i", *dims)) + _element(1, name.encode()) + body)


def encode_mat(data: np.ndarray, srate: float, labels: list[str]) -> bytes:
    """data (channels x samples), srate and chanlabels as a MAT file."""
    text = lambda s: _array("", _CHAR, (1, len(s)), _element(4, s.encode("utf-16-le")))
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM")
    x = _array("data", _DOUBLE, data.shape, _element(9, np.asarray(data, "<f8").tobytes(order="F")))
    return head + x + _array("srate", _DOUBLE, (1, 1), _element(9, struct.pack("<d", srate))) + _array("chanlabels", _CELL, (1, len(labels)), b"".join(text(s) for s in labels))


def _elements(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # a small element holds its bytes in its tag
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def decode_mat(raw: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a MAT file by name; others are passed over."""
    if len(raw) < 128 or raw[126:128] != b"IM":
        raise ValueError("not a MAT file of level 5")
    out = {}
    for kind, body in _elements(raw[128:]):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body)))
        if kind != _MATRIX:
            continue
        (_, flags), (_, dims), (_, name), *rest = list(_elements(body))
        if 6 <= flags[0] <= 15 and rest and rest[0][0] in _NUMBERS:
            out[name.decode()] = np.frombuffer(rest[0][1], _NUMBERS[rest[0][0]]).reshape(np.frombuffer(dims, "<i4"), order="F")
    return out


# --- reader ------------------------------------------------------------------------------------------------------------


@dataclass
class Header:
    """What an EDF or BDF file (2 or 3 bytes a sample) says of its records."""

    start: int
    records: int
    seconds: float
    labels: list[str]
    limits: np.ndarray
    sizes: list[int]
    width: int

    @classmethod
    def of(cls, raw: bytes, width: int) -> Header:
        if len(raw) < 256:
            raise ValueError("shorter than a header")
        count, at, out = int(raw[252:256]), 256, []
        if len(raw) < 256 * (count + 1):
            raise ValueError("shorter than its header")
        for wide in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
            out.append([raw[at + i * wide : at + (i + 1) * wide].decode("latin-1").strip() for i in range(count)])
            at += wide * count
        limits = np.array([[float(v) for v in out[k]] for k in (3, 4, 5, 6)])
        if (limits[3] == limits[2]).any():
            raise ValueError("a signal without a digital range")
        return cls(at, int(raw[236:244]), float(raw[244:252]), out[0], limits, [int(v) for v in out[8]], width)

    @property
    def record(self) -> int:
        return self.width * sum(self.sizes)

    def signals(self, raw: bytes, first: int) -> Iterator[tuple[str, float, np.ndarray, np.ndarray]]:
        """Label, rate, places and physical values of every signal in whole records from record `first` on; annotations not."""
        n = len(raw) // self.record
        x = np.frombuffer(raw, np.uint8, n * self.record).reshape(n, -1, self.width).astype(np.int64)
        digital = sum(x[:, :, b] << (8 * b) for b in range(self.width))
        digital -= (digital >> (8 * self.width - 1)) << (8 * self.width)
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        for i, label in enumerate(self.labels):
            if label.endswith("Annotations") or not self.sizes[i]:
                continue
            (plo, phi, dlo, dhi), d = self.limits[:, i], digital[:, begin[i] : begin[i + 1]].ravel()
            yield label, self.sizes[i] / self.seconds, first * self.sizes[i] + np.arange(len(d)), (d - dlo) / (dhi - dlo) * (phi - plo) + plo


@dataclass
class Part(InputPartition):
    """Records first to last - 1 of a file, or all of it, or why it can't be read."""

    file: str
    kind: str
    first: int = 0
    last: int = 0
    error: str | None = None


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fs = options["path"], float(options.get("fs", 0))
        self.most, self.kind = int(options.get("partbytes", 32 << 20)), options.get("kind")

    def partitions(self) -> list[Part]:
        where, root = store(self.path)
        info = where.get_file_info(root)
        found = [info] if info.type == afs.FileType.File else where.get_file_info(afs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == afs.FileType.File), key=lambda f: f.path):
            kind = self.kind or FORMATS.get(os.path.splitext(f.path)[1].lower())
            if kind is None:
                continue
            if kind not in ("edf", "bdf"):
                out.append(Part(f.path, kind))
                continue
            try:
                h = self.header(where, f.path, kind)
            except (ValueError, OSError, OverflowError) as e:
                out.append(Part(f.path, kind, error=f"{type(e).__name__}: {e}"))
                continue
            held = (f.size - h.start) // h.record
            n, step = (held if h.records < 0 else min(held, h.records)), max(1, self.most // h.record)
            out += [Part(f.path, kind, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [Part("", "none")]

    @staticmethod
    def header(where: afs.FileSystem, path: str, kind: str) -> Header:
        with where.open_input_file(path) as f:
            head = f.read(256)
            more = 256 * int(head[252:256]) if len(head) == 256 else 0
            return Header.of(head + f.read(more), 2 if kind == "edf" else 3)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("signal", pa.string()), ("fs", pa.float64()), ("sample_idx", pa.int64()), ("value", pa.float64()), ("error", pa.string())])
        failed = lambda e: pa.RecordBatch.from_pylist([{"file": part.file, "error": e}], schema=kinds)
        if part.kind == "none":
            return
        if part.error:
            yield failed(part.error)
            return
        where, _ = store(self.path)
        try:
            if part.kind in ("edf", "bdf"):
                h = self.header(where, part.file, part.kind)
                with where.open_input_file(part.file) as f:
                    found = list(h.signals(f.read_at((part.last - part.first) * h.record, h.start + part.first * h.record), part.first))
            else:
                found = list(self.matrix(where, part))
        except Exception as e:  # noqa: BLE001  whatever it is, it is this file's
            yield failed(f"{type(e).__name__}: {e}")
            return
        for label, rate, place, value in found:
            for i in range(0, len(value), 1 << 18):
                n = len(value[i : i + (1 << 18)])
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array([label] * n), pa.array(np.full(n, rate)), pa.array(place[i : i + n]), pa.array(np.asarray(value[i : i + n], float)), pa.nulls(n, pa.string())], schema=kinds)

    def matrix(self, where: afs.FileSystem, part: Part) -> Iterator[tuple[str, float, np.ndarray, np.ndarray]]:
        """The rows of a .npy matrix, or of the largest of a MAT file, as signals E1, E2, ...; turned if it has more rows than columns."""
        if self.fs <= 0:
            raise ValueError("a matrix needs the option fs")
        with where.open_input_file(part.file) as f:
            raw = f.read()
        if part.kind == "npy":
            x = np.load(io.BytesIO(raw), allow_pickle=False)
        else:
            two = [a for a in decode_mat(raw).values() if a.ndim == 2]
            if not two:
                raise ValueError("no matrix of numbers")
            x = max(two, key=lambda a: a.size)
        if x.ndim != 2:
            raise ValueError(f"{x.ndim} dimensions instead of 2")
        for i, row in enumerate(x.T if x.shape[0] > x.shape[1] else x):
            yield f"E{i + 1}", self.fs, np.arange(len(row)), row.astype(float)


class Recordings(DataSource):
    """Options: path (a file or folder, read with all below it), fs (for matrices), kind (instead of the suffix), partBytes
    (bytes of EDF or BDF records that one task reads). Files of other suffixes are passed over; one that can't be read is one row
    with its error."""

    @classmethod
    def name(cls) -> str:
        return "neurolith_recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader({k.lower(): v for k, v in self.options.items()})


# --- writer ------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class MatricesWriter(DataSourceWriter):
    """Rows (name, place, x) sorted by name and place within a partition, each name in one partition: a file each, under a
    temporary name until all tasks have ended; those of a failed task or run are taken away."""

    def __init__(self, options: dict):
        self.path, self.kind, self.rate = options["path"], options.get("kind", "txt"), float(options.get("fs", 0))
        self.labels = [x for x in options.get("labels", "").split("\n") if x]
        if self.kind not in ("txt", "mat"):
            raise ValueError(f"kind: {self.kind!r}")

    def write(self, rows) -> Written:
        where, root = store(self.path)
        where.create_dir(root, recursive=True)
        files, now, out, held = [], None, None, []

        def end():
            if out is not None:
                if self.kind == "mat":
                    out.write(encode_mat(np.array(held, float).T.reshape(len(self.labels) or len(held[0]), -1), self.rate, self.labels or [f"E{i + 1}" for i in range(len(held[0]))]))
                out.close()

        try:
            for r in rows:
                if r[0] != now:
                    end()
                    now, held = r[0], []
                    temporary, final = f"{root}/_{uuid.uuid4().hex}", f"{root}/{str(r[0]).replace('/', '_')}.{self.kind}"
                    out = where.open_output_stream(temporary)
                    files.append((temporary, final))
                if self.kind == "txt":
                    out.write((" ".join(f"{v:.8f}" for v in r[2]) + "\n").encode())
                else:
                    held.append(r[2])
            end()
        except BaseException:
            self.abort([Written(files)])  # the task's next attempt begins anew
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = store(self.path)
        for temporary, final in (f for m in messages if m for f in m.files):
            where.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = store(self.path)
        for temporary, _ in (f for m in messages if m for f in m.files):
            where.delete_file(temporary)


class Matrices(DataSource):
    """Options: path, kind (txt or mat), fs and labels (a line each) for MAT files."""

    @classmethod
    def name(cls) -> str:
        return "neurolith_matrices"

    def schema(self) -> str:
        return "name string, place long, x array<double>"

    def writer(self, schema, overwrite: bool) -> MatricesWriter:
        return MatricesWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    for source in (Recordings, Matrices):
        spark.dataSource.register(source)


def read_recordings(spark: SparkSession, path: str, *, fs: float | None = None, kind: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """file, signal, fs, sample_idx, value, error of all EDF, BDF, .npy and MAT files under a path, by suffix unless kind says."""
    register(spark)
    options = {k: str(v) for k, v in (("fs", fs), ("kind", kind), ("partBytes", part_bytes)) if v is not None}
    return spark.read.format("neurolith_recordings").options(**options).load(path)


def save_matrices(samples: DataFrame, path: str, *, name: str, channel: str, place: list[str], kind: str = "txt", fs: float = 0.0, average: bool = False) -> None:
    """A file for each recording (name): a line for each place, or of a MAT file a column, with a number for each channel, in
    the order of their names (those of the whole table; a missing value is NaN), as %.8f in text.

    place: the columns that order samples, such as sample_idx, or epoch and offset, so that trials follow each other. With
    average, samples at the same last column of place are averaged first (trials by offset). Text is streamed; a MAT file's
    matrix is one recording in one task.
    """
    register(samples.sparkSession)
    labels = [r[0] for r in samples.select(channel).distinct().orderBy(channel).collect()]
    keys = [name, *(place[-1:] if average else place)]
    wide = samples.groupBy(*keys).agg(F.array(*[F.coalesce(F.avg(F.when(F.col(channel) == c, F.col("value"))), F.lit(float("nan"))) for c in labels]).alias("x"))
    rows = wide.repartition(name).sortWithinPartitions(*keys)
    rows = rows.select(F.col(name).cast("string").alias("name"), F.col(keys[-1]).cast("long").alias("place"), "x")
    rows.write.format("neurolith_matrices").option("kind", kind).option("fs", str(fs)).option("labels", "\n".join(labels)).mode("append").save(path)
