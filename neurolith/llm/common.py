"""What the corpus operators share: reading, cutting lineage, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, or a fresh
    local folder if driver and executors are one process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        where = tempfile.mkdtemp(prefix="spark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex}"
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and no executor is needed to keep it.

    What is written stays until the shared folder is cleared, since a result that is read later may need it.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(d: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """d, to be sent to all executors in a join if its rows written as JSON have at most most_bytes; d should be cut."""
    size = d.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(d) if size <= most_bytes else d


def sheltered(docs: DataFrame, *need: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with the needed columns under these names and all others as other0, other1, ..., so that no name of an operator's
    own clashes with theirs; and the way back: its columns as they were, with those of `added` (name: column) after them.

    A needed column is the one of exactly that name, or else the first that differs from it in case only.
    """
    names = docs.columns
    inner = [f"other{i}" for i in range(len(names))]
    for n in need:
        inner[names.index(n) if n in names else [x.lower() for x in names].index(n.lower())] = n

    def back(d: DataFrame, added: dict[str, str] | None = None) -> DataFrame:
        return d.select(*inner, *(added or {}).values()).toDF(*names, *(added or {}))

    return docs.toDF(*inner), back


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """From now on this session sends texts to Python in Arrow batches of about most_bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def n_words(text: Column) -> Column:
    """Words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- numpy, inside tasks -------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value per byte, and the odd multiplier of the polynomial hash and its inverse modulo 2**64.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[data[t]] * MULT**t over i <= t < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(MULT, len(data)), out=out[1:])
    return out


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array end to end, and where each row starts (one more than rows); nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of the texts that lie end to end in data; no word crosses texts. gap says of
    each byte whether it lies between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = prefix_hash(data, BYTE_LOWER if lower else BYTE)
    return start, end, mix((total[end] - total[start]) * powers(MULT_INV, len(data))[start] + (end - start).astype(np.uint64))


def pieces(batches, most_bytes: int = 8 << 20, column: str = "text"):
    """Arrow batches cut so that each holds about most_bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = arrow_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
