"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, exact shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import cut, sheltered


def _range_of(splits: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many splitters are at or below (key, tie), by binary search in two constant arrays."""
    if not splits:
        return F.lit(0)
    ks = F.array(*[F.lit(k).cast("long") for k, _ in splits])
    ts = F.array(*[F.lit(t).cast("long") for _, t in splits])
    at = F.lit(0)
    step = 1 << (len(splits).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1

    def probe(found: Column, by: Column) -> Column:
        to = found + by
        k, t = F.get(ks, to - 1), F.get(ts, to - 1)
        return F.when((to <= len(splits)) & ((k < key) | ((k == key) & (t <= tie))), to).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), at, probe)


def shard_by_sampled_splitters(records: DataFrame, n_shards: int, *, row_id: str, size: str, key: str, ranges_per_shard: int = 64, samples_per_range: int = 64, rows_per_range: int = 200_000, max_ranges: int = 16_384, seed: int = 17) -> DataFrame:
    """Put every record into one of n_shards shards of nearly equal total size.

    Records are ordered by (key, hash of row_id). A Poisson sample that takes a record with a chance proportional to its
    size gives splitters at equal weights, so that a range holds about 1 / ranges of all bytes, however skewed the keys
    are. A splitter falls inside a key only where that key fills whole ranges by itself (it is then subdivided by the hash
    of row_id); otherwise boundaries fall between keys, so records of one key stay in one shard. Exact running sizes
    (range totals, then a window within each range) place every record: its shard is that of its key's first byte in its
    range. Ranges that the sample left over twice full are subdivided by row hash for the windows.

    Adds range, shard (int) and slot (long, gapless from 0 in each shard). The driver sees samples_per_range * ranges
    sampled keys at most, and one row per range. Records must be narrow: carry ids and sizes, not texts. Null keys sort as
    one key of their own (they share a key value), null sizes count as 0; an empty table gives an empty result; repeated
    rows each get a slot of their own, in no defined order among themselves. Other columns pass through, whatever their names;
    only columns named range, shard or slot are replaced.
    """
    records, back = sheltered(records.drop("range", "shard", "slot"), *dict.fromkeys((row_id, size, key)))
    base = cut(records.withColumn("_k", F.coalesce(F.col(key), F.lit(0).cast("long"))).withColumn("_t", F.xxhash64(F.col(row_id), F.lit(seed))).withColumn("_s", F.coalesce(F.col(size), F.lit(0)).cast("long")))
    total, rows = base.agg(F.coalesce(F.sum("_s"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = min(max_ranges, max(ranges_per_shard * n_shards, -(-rows // rows_per_range)))
    chance = F.lit(float(samples_per_range * n_ranges)) * F.col("_s") / F.lit(float(max(total, 1)))
    drawn = (F.xxhash64("_t", F.lit(seed + 1)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < chance
    sample = sorted((r[0], r[1]) for r in base.filter(drawn).select("_k", "_t").collect())

    least = -(1 << 63)
    picks = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)] if sample else []
    splits = set()
    for i, (k, t) in enumerate(picks):
        hot = (i and picks[i - 1][0] == k) or (i + 1 < len(picks) and picks[i + 1][0] == k)
        splits.add((k, least))
        if hot:
            splits.add((k, t))
    splits = sorted(splits)

    placed = base.withColumn("range", _range_of(splits, F.col("_k"), F.col("_t")).cast("int"))
    # Overfull ranges (the sample was unlucky): as many parts by row hash as they are too large.
    share = max(1, total // n_ranges)
    fill = placed.groupBy("range").agg(F.sum("_s").alias("_b"), F.count(F.lit(1)).alias("_n")).select("range", F.greatest(F.lit(1), F.floor(F.col("_b") / F.lit(2 * share)), F.floor(F.col("_n") / F.lit(2 * rows_per_range))).cast("int").alias("_parts"))
    over = [(r[0], r[1]) for r in fill.filter("_parts > 1").collect()]
    part = F.lit(0)
    if over:
        parts = F.map_from_arrays(F.array(*[F.lit(r) for r, _ in over]), F.array(*[F.lit(p) for _, p in over]))
        part = F.coalesce(F.pmod(F.xxhash64("_t", F.lit(seed + 2)), F.element_at(parts, F.col("range"))), F.lit(0))
    placed = placed.withColumn("_part", part.cast("int"))

    sums = placed.groupBy("range", "_part").agg(F.sum("_s").alias("_b"))
    before = sums.select("range", "_part", (F.sum("_b").over(Window.orderBy("range", "_part")) - F.col("_b")).alias("_from"))
    inside = Window.partitionBy("range", "_part").orderBy("_k", "_t", row_id)
    start = F.col("_from") + F.sum("_s").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    run = placed.join(F.broadcast(before), ["range", "_part"]).withColumn("_start", start)
    group_start = F.min("_start").over(Window.partitionBy("range", "_part", "_k"))
    run = run.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(group_start * F.lit(n_shards) / F.lit(max(total, 1)))).cast("int"))

    counts = run.groupBy("shard", "range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("shard", "range", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("range", "_part")) - F.col("_n")).alias("_ahead"))
    slot = F.col("_ahead") + F.row_number().over(Window.partitionBy("range", "_part", "shard").orderBy("_k", "_t", row_id)) - 1
    out = run.join(F.broadcast(ahead), ["shard", "range", "_part"]).withColumn("slot", slot.cast("long"))
    return back(out, {x: x for x in ("range", "shard", "slot")})


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, checksum 0). The law is `bytes`. Copies of one text share a key, so
    they stay in one shard unless they fill whole ranges by themselves. Null ids and repeated rows get slots of their own; an
    empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    docs, _ = sheltered(docs, "doc_id", "text")
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    records = docs.select("doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_key"))
    out = shard_by_sampled_splitters(records, n_shards, row_id="doc_id", size="size", key="_key")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
