"""Files of recordings: round trips, ranges of records, files that can't be read."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from neurolith.sources import formats as M
from neurolith.sources import recordings as R


def bdf(x: np.ndarray, fs: int) -> bytes:
    """One signal of 24-bit numbers, with physical limits equal to the digital ones."""
    field = lambda v, w: str(v).ljust(w).encode()
    head = b"\xffBIOSEMI" + field("", 80) + field("", 80) + field("01.01.85", 8) + field("00.00.00", 8) + field(512, 8) + field("", 44) + field(len(x) // fs, 8) + field(1, 8) + field(1, 4)
    head += field("A1", 16) + field("", 80) + field("uV", 8) + field(-8388608, 8) + field(8388607, 8) + field(-8388608, 8) + field(8388607, 8) + field("", 80) + field(fs, 8) + field("", 32)
    return head + b"".join(struct.pack("<i", int(v))[:3] for v in x)


def test_files_by_suffix_and_ranges_of_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    signals = {"X": rng.normal(size=5000) * 50, "Y": rng.normal(size=5000)}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.edf").write_bytes(R.encode_edf(signals, 100))
    whole = rng.integers(-(2**23), 2**23, 400)
    (tmp_path / "b.bdf").write_bytes(bdf(whole, 100))
    matrix = rng.normal(size=(3, 40))
    (tmp_path / "c.mat").write_bytes(M.encode_mat(matrix, 250.0, ["Fz", "Cz", "Pz"]))
    np.save(tmp_path / "d.npy", matrix.T)
    (tmp_path / "e.edf").write_bytes(b"no header")
    (tmp_path / "f.mat").write_bytes(b"nothing")
    (tmp_path / "g.txt").write_text("passed over")
    d = M.read_recordings(spark, str(tmp_path), fs=250.0, part_bytes=4000)
    assert d.rdd.getNumPartitions() == 5000 // 100 // 10 + 1 + 4  # ten records of 400 bytes a task
    t = d.toPandas()
    t["file"] = t.file.str.rsplit("/").str[-1]
    assert set(t.file[t.error.notna()]) == {"e.edf", "f.mat"} and "g.txt" not in set(t.file)
    get = lambda f, s: t[(t.file == f) & (t.signal == s)].sort_values("sample_idx")
    want, rates = R.decode_edf((tmp_path / "deep" / "a.edf").read_bytes())
    for s in signals:
        assert np.allclose(get("a.edf", s).value, want[s]) and list(get("a.edf", s).sample_idx) == list(range(5000)) and set(get("a.edf", s).fs) == {rates[s]}
    assert np.array_equal(get("b.bdf", "A1").value, whole)
    for f in ("c.mat", "d.npy"):
        assert np.allclose([get(f, f"E{i + 1}").value for i in range(3)], matrix)
    assert M.read_recordings(spark, str(tmp_path / "d.npy")).first().error == "ValueError: a matrix needs the option fs"
    assert M.read_recordings(spark, str(tmp_path / "g.txt")).count() == 0


def test_mat_arrays():
    x = np.arange(6.0).reshape(2, 3)
    raw = M.encode_mat(x, 10.0, ["a", "bc"])
    got = M.decode_mat(raw)
    assert np.array_equal(got["data"], x) and got["srate"] == 10.0 and set(got) == {"data", "srate"}
    squeezed = raw[:128] + b"".join(struct.pack("<II", 15, len(z)) + z for z in (zlib.compress(raw[128:]),))
    assert np.array_equal(M.decode_mat(squeezed)["data"], x)
    small = M._array("n", 12, (1, 1), struct.pack("<HH", 5, 4) + struct.pack("<i", 7))  # an int32 within its tag
    assert M.decode_mat(raw[:128] + small)["n"] == 7


def test_text_and_mat_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {s: rng.normal(size=(2, 50)) for s in ("a", "b/c")}
    rows = pd.concat([pd.DataFrame({"session_id": s, "signal": c, "epoch": np.arange(50) // 10, "at": np.arange(50) % 10, "value": v[i]}) for s, v in x.items() for i, c in enumerate(("X", "Y"))])
    d = spark.createDataFrame(rows).repartition(7)
    M.save_matrices(d, str(tmp_path / "t"), name="session_id", channel="signal", place=["epoch", "at"])
    got = {p.name: np.loadtxt(p) for p in (tmp_path / "t").iterdir()}
    assert set(got) == {"a.txt", "b_c.txt"} and np.allclose(got["a.txt"], x["a"].T, atol=1e-8) and np.allclose(got["b_c.txt"], x["b/c"].T, atol=1e-8)
    assert (tmp_path / "t" / "a.txt").read_text().splitlines()[0] == f"{x['a'][0, 0]:.8f} {x['a'][1, 0]:.8f}"
    M.save_matrices(d, str(tmp_path / "v"), name="session_id", channel="signal", place=["epoch", "at"], average=True)
    assert np.allclose(np.loadtxt(tmp_path / "v" / "a.txt"), x["a"].reshape(2, 5, 10).mean(axis=1).T, atol=1e-8)
    M.save_matrices(d.filter(F.col("session_id") == "a"), str(tmp_path / "m"), name="session_id", channel="signal", place=["epoch", "at"], kind="mat", fs=50.0)
    back = M.decode_mat((tmp_path / "m" / "a.mat").read_bytes())
    assert np.allclose(back["data"], x["a"]) and back["srate"] == 50.0
