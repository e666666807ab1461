"""Suffix-array dedup: bytes in long strings that start twice are removed, found by two-stage suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import BYTE, MULT, MULT_INV, arrow_bytes, cut, mix, pieces, powers, sheltered, small_batches

#: Bytes of the string whose hash is an anchor.
GRAM = 32
#: Bytes of a row with a key and an array in a join's table, besides the array's elements.
ROW = 64


class Hashes:
    """Hashes of any substring of some bytes, in constant time each."""

    def __init__(self, data: np.ndarray):
        self.back = powers(MULT_INV, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(MULT, len(data)), out=self.total[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.back[start])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, size_of_gram: int = GRAM) -> dict[str, np.ndarray]:
    """Every window of `length` bytes within a text, by its anchor: the leftmost least of its grams' hashes.

    Equal windows have equal anchors at equal places. A row is a run of window starts from lo to hi with one anchor: its
    text, lo within that text, span = hi - lo, the anchor's hash as key, and ctx, a hash of all that the run's windows cover
    and of where the anchor lies in it.
    """
    size = np.diff(offsets)
    wide = length - size_of_gram + 1
    n = len(data) - length + 1
    none = {k: np.zeros(0, np.int64) for k in ("text", "lo", "span", "key", "ctx", "at")}
    if n <= 0 or (size < length).all():
        return none
    h = Hashes(data)
    gram = h.of(slice(0, len(data) - size_of_gram + 1), slice(size_of_gram, len(data) + 1))
    v = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    pad = -len(v) % wide
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that lie within a text.
    fine = np.zeros(n + 1, np.int8)
    whole = size >= length
    np.add.at(fine, offsets[:-1][whole], 1)
    np.add.at(fine, np.minimum(offsets[1:][whole] - length + 1, n), -1)
    fine = np.cumsum(fine)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~fine[:-1]
    lo = np.flatnonzero(new & fine)
    last = np.ones(n, bool)
    last[:-1] = (anchor[1:] != anchor[:-1]) | ~fine[1:]
    hi = np.flatnonzero(last & fine)
    at = anchor[lo]
    text = np.searchsorted(offsets, lo, "right") - 1
    ctx = mix(h.of(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    return {"text": text, "lo": lo - offsets[text], "span": hi - lo, "key": gram[at].view(np.int64), "ctx": ctx.view(np.int64), "at": lo}


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of t in the order of their first `depth` bytes at least; t ends with a 0, its least byte.

    Two-stage sorting. Suffixes smaller than their successors (type B) are sorted directly, equal prefixes of `depth` bytes
    once. The others follow by one scan over the buckets of first bytes: a suffix that is larger than its successor stands
    in its bucket in the successor's order, before all of type B.
    """
    n = len(t)
    turn = np.flatnonzero(t[1:] != t[:-1])  # the last place of each run of one byte
    upto = turn[np.minimum(np.searchsorted(turn, np.arange(n - 1)), max(0, len(turn) - 1))] if len(turn) else np.zeros(n - 1, np.int64)
    small = np.ones(n, bool)
    if len(turn):
        small[:-1] = t[upto] < t[upto + 1]
        small[:-1][np.arange(n - 1) > turn[-1]] = True  # a run of the last byte, which is the least
    b = np.flatnonzero(small)
    # Direct sort: different prefixes are found by their hashes, and put in order as byte strings.
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    h = Hashes(padded)
    _, first, same = np.unique(h.of(b, b + depth), return_index=True, return_inverse=True)
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[b[first]]).view(f"S{depth}").ravel()
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(strings, kind="stable")] = np.arange(len(first))
    b = b[np.argsort(rank[same], kind="stable")]
    starts = np.searchsorted(t[b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        larger = [part]
        while len(part):  # runs of c before a smaller byte, one longer each time
            part = part[part > 0] - 1
            part = part[t[part] == c]
            larger.append(part)
        all_ = np.concatenate([*larger, b[starts[c] : starts[c + 1]]])
        out.append(all_)
        before = all_[all_ > 0] - 1
        before = before[t[before] > c]
        byte = t[before]
        before = before[np.argsort(byte, kind="stable")]
        for x, group in zip(*_split(np.sort(byte), before), strict=True):
            waiting[x].append(group)
    return np.concatenate(out)


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.concatenate([[0], cuts])].tolist(), np.split(values, cuts)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The bytes that the suffixes at a and b have in common, as far as `most`: eight at a time, as one word each."""
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)])
    word = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)].astype(np.uint64) << np.uint64(8 * i)
    out = np.full(len(a), most, np.int64)
    going = np.arange(len(a))
    for k in range(0, most, 8):
        x = word[a + k] ^ word[b + k]
        stop = x != 0
        if stop.any():
            low = x[stop] & (~x[stop] + np.uint64(1))  # the lowest differing bit
            out[going[stop]] = np.minimum(most, k + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
            a, b, going = a[~stop], b[~stop], going[~stop]
            if not len(going):
                break
    return out


def repeated_starts(contexts: list[bytes], spans: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context (whose windows start at 0 to its span) the ranges of starts whose window some other start repeats."""
    t = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255: it turns into 0
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in contexts])[:-1]])
    valid = np.zeros(len(t) + 1, np.int32)
    np.add.at(valid, first, 1)
    np.add.at(valid, first + spans + 1, -1)
    valid = np.cumsum(valid)[: len(t)] > 0
    order = suffix_array(t, length)
    order = order[valid[order]]
    twice = np.zeros(len(t) + 1, bool)
    alike = common_prefix(t, order[:-1], order[1:], length) >= length
    twice[order[:-1][alike]] = True
    twice[order[1:][alike]] = True
    edge = np.diff(np.concatenate([[0], twice.view(np.int8)]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for i, x, y in zip((np.searchsorted(first, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        out[i].append((x - int(first[i]), y - int(first[i])))
    return out


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def repeated_spans(docs: DataFrame, *, length: int = 200, contexts_per_key: int = 5_000, bytes_per_bucket: int = 1 << 20, most_broadcast: int = 128 << 20) -> DataFrame:
    """docs (doc_id, text) -> ref (a hash of doc_id and text), spans: byte ranges [from, to) that lie in repeated windows.

    length is over 33. Windows are routed by their anchors as in spans_by_anchor, with grams of 32 bytes; the contexts of hot
    keys once more with grams halfway to a window's length, and what is still hot with grams one byte short of it.
    """
    small_batches(docs.sparkSession)
    d = docs.select(_row_key(docs).alias("ref"), "text").filter(F.octet_length("text") >= length)
    return spans_by_anchor(d, (GRAM, (GRAM + length) // 2, length - 1), length=length, contexts_per_key=contexts_per_key, bytes_per_bucket=bytes_per_bucket, most_broadcast=most_broadcast)


def spans_by_anchor(d: DataFrame, grams: tuple[int, ...], *, length: int, contexts_per_key: int, bytes_per_bucket: int, most_broadcast: int) -> DataFrame:
    """d (ref, text: string or binary, each of `length` bytes at least) -> ref, spans, as repeated_spans gives them.

    Windows are routed by their anchors, about one row per 85 bytes of text with grams of 32 bytes. Keys that occur once end
    there. Contexts that occur as a whole more than once are repeated throughout, however many copies there are (a count per
    context with partial sums). What is left are different contexts with a common key: one of each goes, with its bytes, to
    a bucket of about bytes_per_bucket, where the suffix array of all contexts and its adjacent common prefixes tell which
    windows repeat. A key with more than contexts_per_key different contexts would overfill its bucket: its contexts are
    taken as texts again, and their windows routed by second anchors, made of the next of `grams`. Longer grams are shared by fewer
    contexts; with one of length - 1 bytes a context has at most a byte of its own on each side, so that a key has at most
    66,048 different ones (13 MB), and all go to a bucket. Ranges then return to all rows with the context.

    Places of contexts are broadcast if they have at most most_broadcast bytes as Spark holds them; else texts are shuffled.
    """
    gram, *longer = grams

    def find(batches):
        for batch in pieces(batches, 1 << 20):
            data, offsets = arrow_bytes(batch.column("text"))
            a = anchors(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(a["key"]), pa.array(a["ctx"]), batch.column("ref").take(pa.array(a["text"])), pa.array(a["lo"].astype(np.int32)), pa.array(a["span"].astype(np.int16))], ["key", "ctx", "ref", "lo", "span"])

    rows = cut(d.mapInArrow(find, "key long, ctx long, ref long, lo int, span short"))
    # What joins a hot key is written first: then both sides are plain shuffles, which adaptive execution can split.
    twice = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"))
    rows = cut(rows.join(twice, "key"))
    contexts = rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "lo", "span")).alias("one"))
    contexts = cut(contexts.select("key", "ctx", "n", "one.*"))
    per_key = cut(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"))
    hot = F.col("_k") > contexts_per_key if longer else F.lit(False)
    compare = cut(contexts.join(per_key, "key").withColumn("hot", hot))
    n_compare, n_hot, size = compare.agg(F.count(F.lit(1)), F.count_if("hot"), F.coalesce(F.sum(F.when(~F.col("hot"), F.col("span") + length)), F.lit(0))).first()

    wanted = compare.groupBy("ref").agg(F.collect_list(F.struct("key", "ctx", "lo", "span", "hot")).alias("wanted"))
    # A place is a struct of five words in an array, 56 bytes; at most each has a row of its own.
    wanted = F.broadcast(wanted) if n_compare * (56 + ROW) <= most_broadcast else wanted

    def fetch(batches):
        for batch in pieces(batches, 8 << 20):
            data, offsets = arrow_bytes(batch.column("text"))
            w = batch.column("wanted")
            text = np.repeat(np.arange(batch.num_rows), np.asarray(w.value_lengths()))
            each = w.flatten()
            lo = np.asarray(each.field("lo")) + offsets[text]
            end = lo + np.asarray(each.field("span")) + length
            for i in range(0, len(lo), 4096):
                part = slice(i, i + 4096)
                body = [data[x:y].tobytes() for x, y in zip(lo[part], end[part], strict=True)]
                some = each.slice(i, len(body))
                yield pa.RecordBatch.from_arrays([some.field("key"), some.field("ctx"), some.field("span"), some.field("hot"), pa.array(body, pa.binary())], ["key", "ctx", "span", "hot", "body"])

    bodies = d.join(wanted, "ref").select("text", "wanted").mapInArrow(fetch, "key long, ctx long, span short, hot boolean, body binary")
    bodies = cut(bodies.dropDuplicates(["key", "ctx"]))
    buckets = max(1, -(-int(size) // bytes_per_bucket))

    def sort_bucket(table):
        rows = table.to_pylist()
        found = repeated_starts([r["body"] for r in rows], np.array([r["span"] for r in rows], np.int64), length) if rows else []
        out = [(r["key"], r["ctx"], x, y) for r, ranges in zip(rows, found, strict=True) for x, y in ranges]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"key": pa.array(cols[0], pa.int64()), "ctx": pa.array(cols[1], pa.int64()), "first": pa.array(cols[2], pa.int32()), "last": pa.array(cols[3], pa.int32())})

    by_sort = bodies.filter("NOT hot").withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("_bucket").applyInArrow(sort_bucket, "key long, ctx long, first int, last int")
    whole = contexts.filter("n > 1").select("key", "ctx", F.lit(0).alias("first"), F.col("span").cast("int").alias("last"))
    found = whole.unionByName(by_sort)
    if n_hot:
        again = bodies.filter("hot").select("key", "ctx", F.xxhash64("key", "ctx").alias("ref"), F.col("body").alias("text"))
        spans = cut(spans_by_anchor(again.select("ref", "text"), tuple(longer), length=length, contexts_per_key=contexts_per_key, bytes_per_bucket=bytes_per_bucket, most_broadcast=most_broadcast))
        deeper = again.drop("text").join(spans, "ref").select("key", "ctx", F.inline("spans")).select("key", "ctx", F.col("from").alias("first"), (F.col("to") - length).alias("last"))
        found = found.unionByName(deeper)
    ranges = cut(found.groupBy("key", "ctx").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    hits = rows.join(ranges, ["key", "ctx"]).select("ref", F.inline(F.transform("ranges", lambda r: F.struct((F.col("lo") + r["first"]).alias("from"), (F.col("lo") + r["last"] + length).alias("to")))))
    return merged(hits.groupBy("ref", "from").agg(F.max("to").alias("to")))


def merged(ranges: DataFrame) -> DataFrame:
    """(ref, from, to) -> ref, spans: the ranges of each ref, those that overlap or touch as one."""
    w = Window.partitionBy("ref").orderBy("from")
    ahead = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("_new", F.when(F.col("from") <= ahead, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = runs.groupBy("ref", "_run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return runs.groupBy("ref").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def dedup(docs: DataFrame, *, length: int = 200, keep_text: bool = False, most_broadcast: int = 128 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes), a row for each row.

    Each byte goes that lies in a string of `length` bytes that also starts elsewhere, in any text or the same one. Null
    texts are empty; very long texts count whole; repeated rows repeat each other; an empty table gives an empty result;
    other columns are not looked at. The ranges to remove are broadcast if they have at most most_broadcast bytes as Spark
    holds them; else texts are shuffled to them.
    """
    docs, _ = sheltered(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = cut(repeated_spans(d, length=length))
    n, ranges = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = F.broadcast(spans) if n * ROW + ranges * 32 <= most_broadcast else spans  # a range is a struct of two words, 32 bytes
    joined = d.withColumn("ref", _row_key(d)).join(spans, "ref", "left").select("doc_id", "text", "spans")

    def remove(batches):
        for batch in pieces(batches, 8 << 20):
            data, offsets = arrow_bytes(batch.column("text"))
            out = {"n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_bytes": []}
            for begin, end, ranges in zip(offsets[:-1], offsets[1:], batch.column("spans").to_pylist(), strict=True):
                gone, keep, runs, at = 0, [], 0, 0
                body = data[begin:end]
                last = -1
                for x, y in sorted((r["from"], r["to"]) for r in ranges or ()):
                    if x > last:
                        keep.append(body[at:x])
                        runs, gone, last, at = runs + 1, gone + y - x, y, y
                    elif y > last:
                        gone, last, at = gone + y - last, y, y
                left = b"".join(k.tobytes() for k in (*keep, body[at:]))
                for k, x in (("n_removed", gone), ("n_spans", runs), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept_bytes", left if keep_text else None)):
                    out[k].append(x)
            cols = [pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), *([pa.array(out["kept_bytes"], pa.binary())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if keep_text else [])])

    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text)


def dedup_documents(docs: DataFrame) -> DataFrame:
    return dedup(docs)
