"""Independent components against planted sources."""

from __future__ import annotations

import numpy as np
import pandas as pd

from neurolith.operators import components as C


def test_planted_sources_are_separated_and_muscle_goes(spark, tmp_path):
    rng, fs, n = np.random.default_rng(6), 250.0, 5000
    t = np.arange(n) / fs
    slow = 6 * np.sign(np.sin(2 * np.pi * 3 * t)) + np.convolve(rng.normal(size=n), np.ones(25) / 25, "same")
    muscle = rng.laplace(size=n) * 2
    mixes = {"a": np.array([[1.0, 0.7], [0.4, -1.2]]), "b": np.array([[0.8, -0.5], [1.1, 0.9]])}
    rows = [pd.DataFrame({"session_id": s, "signal": c, "sample_idx": np.arange(n), "value": (m @ np.array([slow, muscle]))[i] + 10 * i}) for s, m in mixes.items() for i, c in enumerate(("X", "Y"))]
    d = spark.createDataFrame(pd.concat(rows), "session_id string, signal string, sample_idx long, value double")
    v, model = C.unmixing(d, "session_id", "signal", str(tmp_path))
    values = C.component_values(v, model, "session_id")
    for s in mixes:
        y = values.filter(values.session_id == s).toPandas().pivot(index="sample_idx", columns="component", values="value").to_numpy()
        r = np.abs(np.corrcoef(np.c_[y, slow, muscle].T)[:2, 2:])
        assert r.max(axis=0).min() > 0.95 and set(r.argmax(axis=0)) == {0, 1}
    marks = C.muscle_components(values, "session_id", fs=fs)
    assert {(r.session_id, r.n_components, r.n_rejected, r.pct_rejected, r.all_rejected) for r in C.rejection_row(marks, "session_id").collect()} == {("a", 2, 1, 50.0, False), ("b", 2, 1, 50.0, False)}
    got = C.remove_components(d, values, model, marks, "session_id", "signal")
    for s, m in mixes.items():
        for i, c in enumerate(("X", "Y")):
            x = got.filter((got.session_id == s) & (got.signal == c)).orderBy("sample_idx").toPandas()
            want = m[i, 0] * slow + 10 * i
            left = x.cleaned - want
            assert np.std(left) < 0.2 * np.std(m[i, 1] * muscle) and np.corrcoef(x.cleaned, want)[0, 1] > 0.97
    none = marks.withColumn("muscle", marks.slope > 1e9)
    assert {r.pct_rejected for r in C.rejection_row(none, "session_id").collect()} == {0.0}
    same = C.remove_components(d, values, model, none, "session_id", "signal")
    assert same.filter("cleaned <> value").count() == 0
