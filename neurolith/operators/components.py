"""Independent components of many recordings at once: Spark adds up each round's moments, small matrices do the rest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.operators import spectra as P

SEED = 20_240_229


def vectors(samples: DataFrame, session: str, channel: str) -> DataFrame:
    """(session, channels, sample_idx, x): the values of all channels of a recording, in the order of their names, at the places
    where none is missing."""
    names = samples.groupBy(session).agg(F.array_sort(F.collect_set(channel)).alias("channels"))
    g = samples.filter("value IS NOT NULL").groupBy(session, "sample_idx").agg(F.array_sort(F.collect_list(F.struct(channel, "value"))).alias("_x"))
    return g.join(names, session).filter(F.size("_x") == F.size("channels")).select(session, "channels", "sample_idx", F.col("_x.value").alias("x"))


def added_up(rows: DataFrame, session: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows (session, x, m) -> (session, n, s): the sums of f(values by row, the recording's m) over all rows of a recording.

    Tasks add up what they hold; only one short array for each recording and batch is shuffled."""
    kind = dict(rows.dtypes)[session]

    def part(batches):
        for b in batches:
            for key, g in b.groupby(session, sort=False):
                s = f(np.stack(g.x.to_numpy()), np.asarray(g.m.iloc[0], float))
                yield pd.DataFrame({session: [key], "n": [len(g)], "s": [s.ravel().tolist()]})

    p = rows.select(session, "x", "m").mapInPandas(part, f"{session} {kind}, n long, s array<double>")
    e = p.select(session, "n", F.posexplode("s").alias("_i", "_v")).groupBy(session, "_i").agg(F.sum("n").alias("n"), F.sum("_v").alias("_v"))
    return e.groupBy(session).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s")).select(session, "n", F.col("_s._v").alias("s"))


def _orthogonal(w: np.ndarray) -> np.ndarray:
    """The nearest matrix with orthonormal rows."""
    u, _, v = np.linalg.svd(w)
    return u @ v


def unmixing(samples: DataFrame, session: str, channel: str, folder: str, *, rounds: int = 60, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """(vectors, model): model has, for each recording, channels, mean, unmix (n x n by rows: what makes components of centred
    values), mix (its inverse) and the rounds taken.

    Values are centred and whitened by their covariance, then all directions turn together by fixed-point rounds for tanh
    until none moves by more than the tolerance. Every recording takes part in each round until all are done; its n x n
    moments are all that a round sends. Vectors and the matrices of each round are written under `folder`, so a round never
    works out the ones before it again. Directions of no variance are taken as they come (weights of at most 1e9).
    """
    spark = samples.sparkSession

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    v = cut(vectors(samples, session, channel), "vectors")
    n_of = F.size("channels")
    second = added_up(v.withColumn("m", F.array(F.lit(0.0))), session, lambda x, m: np.concatenate([x.sum(axis=0), (x.T @ x).ravel()]))

    @F.pandas_udf("struct<mean: array<double>, white: array<double>, m: array<double>>")
    def whiten(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for k, x in zip(n, s, strict=True):
            x = np.asarray(x, float)
            d = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
            mean = x[:d] / k
            values, axes = np.linalg.eigh(x[d:].reshape(d, d) / k - np.outer(mean, mean))
            white = axes.T / np.maximum(np.sqrt(np.maximum(values, 0)), 1e-9)[:, None]
            turn = _orthogonal(np.random.default_rng(SEED).normal(size=(d, d)))
            out.append((mean.tolist(), white.ravel().tolist(), turn.ravel().tolist()))
        return pd.DataFrame(out, columns=["mean", "white", "m"])

    base = cut(second.withColumn("_r", whiten("n", "s")).select(session, "_r.mean", "_r.white", "_r.m"), "white")
    model = base.withColumn("moved", F.lit(1.0)).withColumn("rounds", F.lit(0))

    def moments(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        white, turn = m[d : d + d * d].reshape(d, d), m[d + d * d :].reshape(d, d)
        z = (x - m[:d]) @ white.T
        g = np.tanh(z @ turn.T)
        return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0)])

    @F.pandas_udf("struct<m: array<double>, moved: double>")
    def turned(n: pd.Series, s: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for k, x, old in zip(n, s, m, strict=True):
            d = int(np.sqrt(len(old)))
            old, x = np.asarray(old, float).reshape(d, d), np.asarray(x, float) / k
            new = _orthogonal(x[: d * d].reshape(d, d) - x[d * d :, None] * old)
            out.append((new.ravel().tolist(), float(np.abs(np.abs((new * old).sum(axis=1)) - 1).max())))
        return pd.DataFrame(out, columns=["m", "moved"])

    for i in range(rounds):
        state = model.select(session, F.concat("mean", "white", "m").alias("m"))
        s = added_up(v.join(state, session), session, moments)
        t = model.select(session, "mean", "white", "m").join(s, session).withColumn("_t", turned("n", "s", "m"))
        model = cut(t.select(session, "mean", "white", "_t.m", "_t.moved", F.lit(i + 1).alias("rounds")), f"round_{i % 2}_{i}")
        if not model.filter(F.col("moved") > tolerance).limit(1).count():
            break

    @F.pandas_udf("struct<unmix: array<double>, mix: array<double>>")
    def matrices(white: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(white, m, strict=True):
            d = int(np.sqrt(len(b)))
            u = np.asarray(b, float).reshape(d, d) @ np.asarray(a, float).reshape(d, d)
            out.append((u.ravel().tolist(), np.linalg.pinv(u).ravel().tolist()))
        return pd.DataFrame(out, columns=["unmix", "mix"])

    names = v.groupBy(session).agg(F.first("channels").alias("channels"))
    fit = model.withColumn("_u", matrices("white", "m")).join(names, session).select(session, "channels", "mean", "_u.unmix", "_u.mix", "rounds")
    return v, cut(fit.filter(n_of > 0), "model")


def component_values(v: DataFrame, model: DataFrame, session: str) -> DataFrame:
    """(session, component, sample_idx, value): what each component is at each place."""
    d = v.drop("channels").join(model.select(session, "mean", "unmix"), session)
    n = F.size("mean")
    centred = F.zip_with("x", "mean", lambda a, b: a - b)
    d = d.withColumn("_x", centred).withColumn("component", F.explode(F.sequence(F.lit(0), n - 1)))
    row = F.slice("unmix", F.col("component") * n + 1, n)
    return d.select(session, "component", "sample_idx", F.aggregate(F.zip_with("_x", row, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("value"))


def muscle_components(values: DataFrame, session: str, *, fs: float, low: float = 20.0, high: float = 90.0, least_slope: float = -0.5) -> DataFrame:
    """(session, component, slope, muscle): the slope of the log of the density over the log of frequency from low to high Hz;
    muscles are flat there, so a slope over least_slope is theirs. Components of too low a rate have no slope and are none."""
    p = P.power_density(values, [session, "component"], fs=fs, size=max(8, int(2 * fs))).filter(F.col("freq").between(low, min(high, 0.45 * fs)))
    slope = F.regr_slope(F.log(F.greatest("power", F.lit(1e-30))), F.log("freq"))
    found = values.select(session, "component").distinct().join(p.groupBy(session, "component").agg(slope.alias("slope")), [session, "component"], "left")
    return found.withColumn("muscle", F.coalesce(F.col("slope") > least_slope, F.lit(False)))


def remove_components(samples: DataFrame, values: DataFrame, model: DataFrame, marks: DataFrame, session: str, channel: str, bad: str = "muscle") -> DataFrame:
    """samples with cleaned: less the share that the marked components have in each channel; as it was where a place has no
    components."""
    marked = values.join(marks.filter(bad).select(session, "component"), [session, "component"])
    weights = model.select(session, F.size("channels").alias("_n"), "mix", F.posexplode("channels").alias("_c", channel))
    part = marked.join(weights, session).withColumn("_v", F.col("value") * F.element_at("mix", (F.col("_c") * F.col("_n") + F.col("component") + 1).cast("int")))
    gone = part.groupBy(session, channel, "sample_idx").agg(F.sum("_v").alias("_g"))
    return samples.join(gone, [session, channel, "sample_idx"], "left").withColumn("cleaned", F.col("value") - F.coalesce("_g", F.lit(0.0))).drop("_g")


def rejection_row(marks: DataFrame, session: str, bad: str = "muscle") -> DataFrame:
    """(session, n_components, n_rejected, pct_rejected, all_rejected) of each recording; 0 % where nothing goes."""
    n, k = F.count(F.lit(1)), F.count_if(F.col(bad))
    return marks.groupBy(session).agg(n.alias("n_components"), k.alias("n_rejected"), (k * 100.0 / n).alias("pct_rejected"), (k == n).alias("all_rejected"))
