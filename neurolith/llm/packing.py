"""Variable-capacity best-fit packing: several sequence lengths at once, each bin downsized to its contents in the end."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import cut, n_words, sheltered

#: The production bins, in tokens. A bin of c tokens costs c + CHARGE + ATTENTION * c * c: its length, a fixed charge for one more
#: sequence, and attention, which grows with the square of the length.
CAPACITIES = (512, 1024, 2048, 4096)
CHARGE = 32.0
ATTENTION = 1 / 16_384


class Waiting:
    """Lengths that wait to be packed: how many of each there are, and which ones are left, in order."""

    def __init__(self, lengths: np.ndarray):
        different, counts = np.unique(lengths, return_counts=True)
        self.left, self.count = different.tolist(), dict(zip(different.tolist(), counts.tolist(), strict=True))

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n], self.left[bisect.bisect_left(self.left, n)]

    def fill(self, room: int) -> int:
        """The tokens that get into this room if the longest waiting length that fits goes in, again and again."""
        filled, at = 0, bisect.bisect_right(self.left, room) - 1
        while at >= 0:
            n = self.left[at]
            times = min(self.count[n], (room - filled) // n)
            filled += times * n
            at = min(at - 1, bisect.bisect_right(self.left, room - filled) - 1)
        return filled


def pack_lengths(lengths: np.ndarray, capacities: tuple[int, ...], charge: float, attention: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths of 1 to the largest capacity, longest first: the bin of each, its place in it, and the bins' sizes.

    A length goes to the open bin that it leaves with the least room. If none has room, a bin is opened: of the capacities
    that hold the length, the one with the least cost per token that it will hold, which is the length and what the waiting
    lengths can fill of the rest. Ties: the larger capacity. So every size competes at each opening, by what is left to pack.
    At the end each bin shrinks to the least capacity that holds what is in it.
    """
    capacities = tuple(sorted(capacities))
    bins, starts, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    rooms: list[int] = []  # distinct rooms of open bins, in order
    by_room: dict[int, list[int]] = {}
    waiting = Waiting(lengths)
    for i, n in enumerate(lengths.tolist()):
        waiting.take(n)
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: ((c + charge + attention * c * c) / (n + waiting.fill(c - n)), -c))
            b = len(used)
            used.append(0)
        bins[i], starts[i] = b, used[b]
        used[b] += n
        if rest := room - n:
            if rest not in by_room:
                by_room[rest] = []
                bisect.insort(rooms, rest)
            by_room[rest].append(b)
    sizes = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, starts, sizes


def pack(docs: DataFrame, *, tokens: Column, capacities: tuple[int, ...] = CAPACITIES, charge: float = CHARGE, attention: float = ATTENTION, tokens_per_group: int = 4_000_000) -> DataFrame:
    """Pack documents into bins: doc_id, piece (int), piece_start, n_tokens (long), bin string, bin_start, capacity (int).

    A document longer than the largest capacity is cut into pieces of that size and a rest. Full pieces are bins of their
    own and need no packing; the others are dealt by a hash to groups of about tokens_per_group, each packed by itself in
    one task (the loss is at most a few bins a group). Rows of one id and number of tokens are counted first and numbered
    from the count, so the hash of id, number and piece spreads copies and hot sources evenly, and the bins are the same
    however the rows lie in files and partitions. Documents without tokens (null texts too) get one row with n_tokens 0 and
    null bin, bin_start and capacity; repeated rows and null ids are packed each; an empty table gives an empty result;
    other columns are not looked at, but by tokens.
    """
    most = max(capacities)
    d = cut(docs.select("doc_id", tokens.cast("long").alias("_n")).groupBy("doc_id", "_n").agg(F.count(F.lit(1)).alias("_times")))
    total = d.agg(F.coalesce(F.sum(F.col("_n") * F.col("_times")), F.lit(0))).first()[0]
    groups = max(1, -(-total // tokens_per_group))
    # Number the repeats in two steps, so that no array is as long as a hot id has rows.
    d = d.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(4096).cast("long"))))
    d = d.withColumn("_row", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 4095, F.col("_times") - 1))))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(most).cast("long"))
    p = d.select("doc_id", "_n", "_row", F.posexplode(starts).alias("piece", "piece_start"))
    p = p.withColumn("n_tokens", F.least(F.lit(most).cast("long"), F.col("_n") - F.col("piece_start")))
    whole = p.filter((F.col("n_tokens") == most) | (F.col("n_tokens") == 0))
    full = F.col("n_tokens") == most
    name = F.when(F.col("doc_id").isNull(), "null").otherwise(F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    done = whole.select(
        "doc_id", "piece", "piece_start", "n_tokens", F.when(full, F.concat_ws("-", F.lit("full"), name, "_n", "_row", "piece")).alias("bin"),
        F.when(full, F.lit(0)).alias("bin_start"), F.when(full, F.lit(most)).alias("capacity"),
    )
    rest = p.filter((F.col("n_tokens") < most) & (F.col("n_tokens") > 0)).withColumn("_key", F.xxhash64("doc_id", "_n", "_row", "piece"))
    rest = rest.withColumn("_group", F.pmod(F.col("_key"), F.lit(groups)).cast("int"))

    def pack_group(key, rows):
        rows = rows.sort_values(["n_tokens", "_key", "_row", "piece"], ascending=[False, True, True, True], ignore_index=True)
        bins, at, sizes = pack_lengths(rows.n_tokens.to_numpy(np.int64), capacities, charge, attention)
        rows["bin"] = [f"{key[0]}-{b}" for b in bins]
        rows["bin_start"], rows["capacity"] = at, sizes[bins]
        return rows[["doc_id", "piece", "piece_start", "n_tokens", "bin", "bin_start", "capacity"]]

    kind = dict(docs.dtypes)["doc_id"]
    packed = rest.select("doc_id", "piece", "piece_start", "n_tokens", "_row", "_key", "_group").groupBy("_group").applyInPandas(pack_group, f"doc_id {kind}, piece int, piece_start long, n_tokens long, bin string, bin_start int, capacity int")
    return done.unionByName(packed)


def pack_documents(docs: DataFrame) -> DataFrame:
    """The production packing; tokens are words. Nulls, empty tables and other columns: as in pack, whatever the columns' names."""
    docs, _ = sheltered(docs, "doc_id", "text")
    return pack(docs, tokens=n_words(F.col("text")))
