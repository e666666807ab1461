"""Line dedup: two Bloom filters, of hashes seen once and seen twice, find the lines that may repeat; only these are shuffled
for exact confirmation and for the choice of the document that keeps them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import BYTE_LOWER, MULT_INV, SPACE, arrow_bytes, cut, mix, pieces, powers, prefix_hash, sheltered, small_batches

#: Bits for each key that is taken in, and bits that a key sets. The first filter, which stays where it is filled, takes about
#: one key in 700 for seen; the second, which is sent, holds such keys and the repeats, and is that much emptier.
ONCE_BITS, ONCE_PROBES, TWICE_BITS, TWICE_PROBES = 12, 4, 4, 2
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
PIECE = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of the texts that lie end to end in data, and where each text's lines begin (one more)."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1) + 1)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    at = np.arange(len(breaks)) + text + 1
    start[at], end[at - 1] = breaks + 1, breaks
    return start, end, first


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines whose key is long enough: their numbers, where the key starts and ends, and its 64-bit hash."""
    none = np.zeros(0, np.int64)
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        return none, none, none, none.astype(np.uint64)
    begin = solid[np.minimum(np.searchsorted(solid, start), len(solid) - 1)]
    stop = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    line = np.flatnonzero((begin < stop) & (begin >= start) & (stop <= end) & (chars[np.maximum(stop, begin)] - chars[begin] >= max(1, least_chars)))
    begin, stop = begin[line], stop[line]
    total = prefix_hash(data, BYTE_LOWER)
    return line, begin, stop, mix((total[stop] - total[begin]) * powers(MULT_INV, len(data))[begin] + (stop - begin).astype(np.uint64))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def places(h: np.ndarray, j: int, n_bits: np.ndarray | int) -> np.ndarray:
    """The j-th bit of a hash within its segment of n_bits, fewer than 2**32."""
    with np.errstate(over="ignore"):
        return ((mix(h + np.uint64(j + 1) * _STEP) >> np.uint64(32)) * np.asarray(n_bits).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def by_document(document: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once for each document that holds it, sorted by document."""
    order = np.lexsort((h, document))
    document, h = document[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (document[1:] != document[:-1])
    return document[new], h[new]


def twice_seen(docs: DataFrame, *, segments: int, least_chars: int) -> DataFrame:
    """docs (text) -> (segment, bits): the filter of the hashes that more than one document may hold, by segments of hashes.

    A task sends each hash of a piece of the texts once, in packed arrays. A segment takes these arrays one after the other:
    a hash whose bits are all in the first filter goes to the second, and then all go to the first. Both filters grow with
    the hashes that they take, and hashes are dealt to segments, so a segment is as large as any other whatever the lines.
    """

    def gather(batches):
        for batch in pieces(batches, PIECE):
            data, offsets = arrow_bytes(batch.column("text"))
            start, end, first = lines(data, offsets)
            line, _, _, h = keys(data, start, end, least_chars)
            _, h = by_document(np.searchsorted(first, line, "right") - 1, h)
            h, n = np.unique(h, return_counts=True)
            of = segment_of(h, segments)
            order = np.argsort(of, kind="stable")
            h, n, edge = h[order], n[order], np.searchsorted(of[order], np.arange(segments + 1))
            some = [s for s in range(segments) if edge[s] < edge[s + 1]]
            part = [(h[edge[s] : edge[s + 1]], n[edge[s] : edge[s + 1]] > 1) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x.tobytes() for x, _ in part], pa.binary()), pa.array([x[y].tobytes() for x, y in part], pa.binary())], ["segment", "seen", "again"])

    def fill(key, table):
        seen = [np.frombuffer(x, np.uint64) for x in table.column("seen").to_pylist()]
        n = 8 + sum(map(len, seen))
        once, twice = np.zeros(ONCE_BITS * n, bool), np.zeros(8 * -(-TWICE_BITS * n // 8), bool)
        for h, again in zip(seen, table.column("again").to_pylist(), strict=True):
            at = [places(h, j, len(once)) for j in range(ONCE_PROBES)]
            repeated = np.concatenate([h[np.logical_and.reduce([once[x] for x in at])], np.frombuffer(again, np.uint64)])
            for x in at:
                once[x] = True
            for j in range(TWICE_PROBES):
                twice[places(repeated, j, len(twice))] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    gathered = docs.select("text").mapInArrow(gather, "segment int, seen binary, again binary")
    return cut(gathered.groupBy("segment").applyInArrow(fill, "segment int, bits binary"))


def suspected(h: np.ndarray, bits: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the second filter, whose segments lie end to end in bits."""
    of = segment_of(h, len(n_bytes))
    size, first = 8 * n_bytes[of], 8 * (np.cumsum(n_bytes) - n_bytes)[of]
    out = size > 0
    for j in range(TWICE_PROBES):
        at = np.where(out, first + places(h, j, size), 0)
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _low(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[i:j].lower() for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]


def suspects(docs: DataFrame, filters: DataFrame, *, segments: int, least_chars: int, most_broadcast: int) -> DataFrame:
    """docs (_row, doc_id, text) -> (_row, doc_id, key) for each suspected key of each document.

    The second filter is sent to all tasks if it is within most_broadcast bytes; beyond that, hashes go to the filter's
    segments and are probed there, and those that are held come back to their row.
    """
    size = {r[0]: r[1] for r in filters.select("segment", F.octet_length("bits")).collect()}
    n_bytes = np.array([size.get(s, 0) for s in range(segments)], np.int64)
    schema = f"_row long, doc_id {dict(docs.dtypes)['doc_id']}, key string"

    def found(batch, row, begin, stop, data):
        return pa.RecordBatch.from_arrays([batch.column("_row").take(row), batch.column("doc_id").take(row), pa.array(_low(data, begin, stop), pa.binary()).cast(pa.string())], ["_row", "doc_id", "key"])

    def marked(batch):
        data, offsets = arrow_bytes(batch.column("text"))
        start, end, first = lines(data, offsets)
        line, begin, stop, h = keys(data, start, end, least_chars)
        return data, begin, stop, h, np.searchsorted(first, line, "right") - 1

    if n_bytes.sum() <= most_broadcast:
        bits, starts = np.zeros(max(1, n_bytes.sum()), np.uint8), np.cumsum(n_bytes) - n_bytes
        for r in filters.toLocalIterator():
            bits[starts[r[0]] : starts[r[0]] + len(r[1])] = np.frombuffer(r[1], np.uint8)
        sent = docs.sparkSession.sparkContext.broadcast(bits)

        def probe(batches):
            for batch in pieces(batches, PIECE):
                data, begin, stop, h, row = marked(batch)
                hit = suspected(h, sent.value, n_bytes)
                yield found(batch, pa.array(row[hit]), begin[hit], stop[hit], data)

        return docs.select("_row", "doc_id", "text").mapInArrow(probe, schema)

    def spread(batches):
        for batch in pieces(batches, PIECE):
            _, _, _, h, row = marked(batch)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(h, segments).astype(np.int32)), batch.column("_row").take(pa.array(row)), pa.array(h.view(np.int64))], ["segment", "_row", "h"])

    def hold(asked, made):
        h = asked.column("h").to_numpy().view(np.uint64)
        hit = np.zeros(len(h), bool)
        for b in made.column("bits").to_pylist():
            n = np.zeros(segments, np.int64)
            n[made.column("segment")[0].as_py()] = len(b)
            hit = suspected(h, np.frombuffer(b, np.uint8), n)
        return asked.filter(pa.array(hit)).select(["_row", "h"])

    def pick(batches):
        for batch in pieces(batches, PIECE):
            data, begin, stop, h, row = marked(batch)
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column("held").to_pylist()])
            held = {(int(i), int(x)) for i, x in zip(of, batch.column("held").flatten().to_pylist(), strict=True)}
            hit = np.array([x in held for x in zip(row.tolist(), h.view(np.int64).tolist(), strict=True)], bool)
            yield found(batch, pa.array(row[hit]), begin[hit], stop[hit], data)

    asked = docs.select("_row", "text").mapInArrow(spread, "segment int, _row long, h long").distinct()
    held = asked.groupBy("segment").cogroup(filters.groupBy("segment")).applyInArrow(hold, "_row long, h long")
    held = held.groupBy("_row").agg(F.collect_set("h").alias("held"))
    return docs.join(held, "_row").select("_row", "doc_id", "text", "held").mapInArrow(pick, schema)


def dedup_lines(docs: DataFrame, *, text: str = "text", least_chars: int = 40, least_docs: int = 5, most_broadcast: int = 256 << 20, segment_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text) -> docs with kept_text, n_lines (before dropping) and n_dropped (long).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least least_chars code
    points that at least least_docs documents hold lose their lines everywhere but in the document of the largest doc_id
    among them, which keeps all its own. Documents are told apart by doc_id: rows that share one (null too, which is below
    all others) count as one document and keep or lose lines alike. A null text has one empty line and stays null; an empty
    one has one empty line; very long texts and lines count whole; an empty table gives an empty one. Other columns pass
    through, whatever their names; only columns named like an added one are replaced.

    What is confirmed is told by the whole text of the key, by partial sums, so a line that very many documents hold meets in
    small counts. The confirmed keys are sent to all tasks if they are within most_broadcast bytes; beyond that, suspects are
    joined with them (adaptive execution splits hot keys), and each row takes what it loses.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    d, back = sheltered(docs.drop(*added), "doc_id", text)
    d = d.withColumnRenamed(text, "text")
    small_batches(d.sparkSession)
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    how = {"segments": max(8, -(-size // segment_bytes)), "least_chars": least_chars}
    filters = twice_seen(d, **how)
    how["most_broadcast"] = most_broadcast
    n_bytes = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    numbered = n_bytes > most_broadcast
    d = cut(d.withColumn("_row", F.monotonically_increasing_id())) if numbered else d.withColumn("_row", F.lit(0).cast("long"))
    maybe = suspects(d, filters, **how)
    maybe = cut(maybe) if numbered else maybe
    confirmed = maybe.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    confirmed = cut(confirmed.filter(F.col("n") >= least_docs).select("key", "keeper"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "_row") + ", kept_text string, n_lines long, n_dropped long"
    names = [c for c in d.columns if c != "_row"]

    def rebuilt(batch, lost):
        """The batch with what is left of each text; lost gives whether each keyed line goes."""
        data, offsets = arrow_bytes(batch.column("text"))
        start, end, first = lines(data, offsets)
        line, begin, stop, h = keys(data, start, end, least_chars)
        row = np.searchsorted(first, line, "right") - 1
        gone = np.zeros(len(start), bool)
        gone[line[lost(data, begin, stop, h, row)]] = True
        n_gone = np.concatenate([[0], np.cumsum(gone)])
        n_gone = n_gone[first[1:]] - n_gone[first[:-1]]
        left, raw = batch.column("text").to_pylist() if n_gone.any() else None, None
        for i in np.flatnonzero(n_gone):
            raw = data.tobytes() if raw is None else raw
            left[i] = b"\n".join(raw[start[k] : end[k]] for k in range(first[i], first[i + 1]) if not gone[k]).decode()
        kept = batch.column("text") if left is None else pa.array(left, pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), kept, pa.array(np.diff(first), pa.int64()), pa.array(n_gone, pa.int64())], [*names, *added])

    if confirmed.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0] <= most_broadcast:
        rows = confirmed.collect()
        raw = b"".join(r[0].encode() for r in rows)
        stop = np.cumsum([len(r[0].encode()) for r in rows], dtype=np.int64)
        _, _, _, h = keys(np.frombuffer(raw, np.uint8), np.concatenate([[0], stop])[:-1].astype(np.int64), stop, 1)
        sent = d.sparkSession.sparkContext.broadcast((np.unique(h), {r[0].encode(): r[1] for r in rows}))
        del rows, raw

        def drop(batches):
            known, keeper = sent.value

            def lost(data, begin, stop, h, row):
                out = np.zeros(len(h), bool)
                if not len(known):
                    return out
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                own = ids.take(pa.array(row[hit])).to_pylist()
                for i, key, doc in zip(hit, _low(data, begin[hit], stop[hit]), own, strict=True):
                    out[i] = key in keeper and keeper[key] != doc
                return out

            for batch in pieces(batches, PIECE):
                ids = batch.column("doc_id")
                yield rebuilt(batch, lost)

        return back(d.drop("_row").mapInArrow(drop, schema).withColumnRenamed("text", text), {c: c for c in added})

    if not numbered:
        d = cut(d.withColumn("_row", F.monotonically_increasing_id()))
        maybe = suspects(d, filters, **how)

    def drop_joined(batches):
        for batch in pieces(batches, PIECE):
            of = [set() if x is None else {k.encode() for k in x} for x in batch.column("_lost").to_pylist()]
            yield rebuilt(batch, lambda data, begin, stop, h, row: np.array([k in of[i] for k, i in zip(_low(data, begin, stop), row.tolist(), strict=True)], bool))  # noqa: B023

    losing = maybe.join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("_row").agg(F.collect_set("key").alias("_lost"))
    return back(d.join(losing, "_row", "left").drop("_row").mapInArrow(drop_joined, schema).withColumnRenamed("text", text), {c: c for c in added})


def dedup_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_lines, n_dropped, kept_sha256; nulls, ties, long texts and names as in dedup_lines."""
    docs, _ = sheltered(docs, "doc_id", "text")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id"""
