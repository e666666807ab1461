"""Language-model scoring: n-gram counts on a log scale in a Bloom filter, smoothed by repeated membership probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import arrow_bytes, cut, mix, pieces, sheltered, small_batches, words

#: Stands for the end of a text, and before its first word for its start.
END = np.uint64(0x5BD1E9955BD1E995)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Within its segment a pair is told apart by this many bytes of its hash, below those that choose the segment.
PAIR_BYTES = 5
PAIR = np.uint64((1 << 8 * PAIR_BYTES) - 1)


def thresholds(base: float = 1.5, levels: int = 96) -> np.ndarray:
    """The least count of each level: 0 at level 0, 1 at level 1, then by the base. Every counted n-gram has a level."""
    out = [0, 1]
    while len(out) <= levels:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * base))))
    return np.array(out, np.float64)


LEVELS = thresholds()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right") - 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts end to end, each text's with END after it, and the number of tokens of each text."""
    start, _, h = words(data, offsets, lower=True)
    first = np.searchsorted(start, offsets)  # a text's words begin here
    n = np.diff(first) + 1
    out = np.full(len(h) + len(n), END, np.uint64)
    out[np.arange(len(h)) + np.searchsorted(offsets, start, "right") - 1] = h
    return out, n


def bigrams(token: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; texts lie end to end, so the one before the first is END."""
    before = np.concatenate([[END], token[:-1]]).astype(np.uint64)
    return mix(before * _A + token)


def text_tokens(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As tokens, of a batch's texts; about most_bytes are hashed at a time, since that takes many bytes of memory for each."""
    parts = [tokens(*arrow_bytes(x.column("text"))) for x in pieces([batch], most_bytes)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def pack(kind: int, h: np.ndarray) -> bytes:
    """Words (kind 1) as whole hashes, pairs (kind 2) as what tells them apart within a segment."""
    return h.tobytes() if kind == 1 else np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]).tobytes()


def unpack(kind: int, packed: bytes) -> np.ndarray:
    if kind == 1:
        return np.frombuffer(packed, np.uint64)
    out = np.zeros((len(packed) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, PAIR_BYTES)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def by_segment(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys from 0 to n - 1 and keeps that of equal ones, and where each key begins in it."""
    key = key.astype(np.uint16 if n <= 1 << 16 else np.int32)  # short keys are sorted by counting
    return np.argsort(key, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])


def bits_of(h: np.ndarray, level: np.ndarray | int, j: int, n_bits: np.ndarray | int) -> np.ndarray:
    """The j-th bit of (n-gram, level) within its segment of n_bits, fewer than 2**32."""
    with np.errstate(over="ignore"):
        x = mix((h & PAIR) + np.asarray(level).astype(np.uint64) * _A + np.uint64(j) * _B)
    return ((x >> np.uint64(32)) * np.asarray(n_bits).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


class LogFilter:
    """Segments of a Bloom filter end to end; an n-gram's level L is held as the members (n-gram, 1) to (n-gram, L).

    The first member has probes[0] bits, the others, which only n-grams with the first are asked for, probes[1].
    """

    def __init__(self, segments: list[bytes], probes: tuple[int, int]):
        self.lay_out([len(s) for s in segments], np.frombuffer(b"".join(segments), np.uint8), probes)

    @classmethod
    def laid_out(cls, n_bytes: list[int], bits: np.ndarray, probes: tuple[int, int]) -> LogFilter:
        """The filter of segments that lie end to end in bits, without a copy of them."""
        out = cls.__new__(cls)
        out.lay_out(n_bytes, bits, probes)
        return out

    def lay_out(self, n_bytes: list[int], bits: np.ndarray, probes: tuple[int, int]) -> None:
        self.probes, self.bits = probes, bits
        self.size = 8 * np.array(n_bytes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level by level, until a member is missing; after each probe only those not yet missing go on."""
        out = np.zeros(len(h), np.int64)
        if not len(self.size):
            return out
        at = np.arange(len(h))
        segment = segment_of(h, len(self.size))
        first, size = self.first[segment], self.size[segment]
        for level in range(1, len(LEVELS)):
            for j in range(self.probes[level > 1]):
                bit = first + bits_of(h, level, j, size)
                held = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                at, h, first, size = at[held], h[held], first[held], size[held]
                if not len(at):
                    return out
            out[at] = level
        return out


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def make_segment(h: np.ndarray, level: np.ndarray, probes: tuple[int, int], bits_per_probe: float) -> bytes:
    """The filter's segment of n-grams with these levels (those of level 0 have no member)."""
    set_ = int((level > 0).sum()) * probes[0] + int(np.maximum(level - 1, 0).sum()) * probes[1]
    n_bits = 8 * max(1, int(set_ * bits_per_probe) // 8)
    bits = np.zeros(n_bits, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        part = h[level >= at]
        for j in range(probes[at > 1]):
            bits[bits_of(part, at, j, n_bits)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sum_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h, n
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


def count_ngrams(texts: DataFrame, segments: int, most_bytes: int = 12 << 20) -> DataFrame:
    """texts (text) -> (kind 1 words or 2 word pairs, segment, h, n): packed hashes, and the uint32 counts of the first of
    them; the others were met once.

    Each task adds up what a piece of the texts has before it sends anything; hashes are dealt to segments, so every
    segment is as large as any other, whatever the words. Several rows of a segment are still to be added up.
    """

    def count(batches):
        for batch in pieces(batches, most_bytes):
            token, _ = text_tokens(batch)
            for kind, all_ in ((1, token), (2, bigrams(token))):
                h, n = np.unique(all_, return_counts=True)
                order, cuts = by_segment(2 * segment_of(h, segments) + (n == 1), 2 * segments)
                h, n = h[order], n[order].astype(np.uint32)
                some = [x for x in range(segments) if cuts[2 * x] < cuts[2 * x + 2]]
                for i in range(0, len(some), 64):
                    part = some[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([pack(kind, h[cuts[2 * x] : cuts[2 * x + 2]]) for x in part], pa.binary()), pa.array([n[cuts[2 * x] : cuts[2 * x + 1]].tobytes() for x in part], pa.binary())], ["kind", "segment", "h", "n"])

    return texts.select("text").mapInArrow(count, "kind int, segment int, h binary, n binary")


def count_tables(texts: DataFrame, *, segments: int, probes: tuple[int, int], bits_per_probe: float) -> DataFrame:
    """texts (text) -> one row for each (kind, segment): sorted hashes and their counts of words, the filter's segment of pairs.

    Words keep their exact counts; of pairs, only the filter of their levels is kept.
    """

    def add_up(key, table):
        kind, h, n = key[0].as_py(), [], []
        for packed, counts in zip(table.column("h").to_pylist(), table.column("n").to_pylist(), strict=True):
            h.append(unpack(kind, packed))
            n += [np.frombuffer(counts, np.uint32).astype(np.int64), np.ones(len(h[-1]) - len(counts) // 4, np.int64)]
        h, n = _sum_up(np.concatenate(h), np.concatenate(n))
        made = b""
        if kind == 2:
            made = make_segment(h, level_of(n), probes, bits_per_probe)
            h, n = h[:0], n[:0]
        return pa.table({"kind": pa.array([kind], pa.int32()), "segment": pa.array([key[1].as_py()], pa.int32()), "size": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()), "h": pa.array([h.tobytes()], pa.binary()), "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()), "filter": pa.array([made], pa.binary())})

    counted = count_ngrams(texts, segments)
    conf, let_go = texts.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(let_go, None)
    conf.set(let_go, "true")  # what was shuffled goes once the tables are written, not whenever the driver collects its garbage
    try:
        return cut(counted.groupBy("kind", "segment").applyInArrow(add_up, "kind int, segment int, size long, total long, h binary, n binary, filter binary"))
    finally:
        conf.unset(let_go) if was is None else conf.set(let_go, was)


def counts_of(word: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The counts of words, 0 where they aren't among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(word), np.int64)
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    return np.where(known[at] == word, count[at], 0)


def log_probability(c_word: np.ndarray, c_before: np.ndarray, level: np.ndarray, total: int, distinct: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base probability and of the model's: the pair's count (the least of its level) over that of its first
    word, drawn towards the base probability of the word by `strength` imagined occurrences."""
    base = (c_word + 1.0) / (total + 1.0 * (distinct + 1))
    return np.log10(base), np.log10((np.minimum(LEVELS[level], np.minimum(c_word, c_before)) + strength * base) / (c_before + strength))


def scored(batch: pa.RecordBatch, n_tokens: np.ndarray, c: np.ndarray, end: float, level: np.ndarray, total: int, distinct: int, strength: float) -> list:
    """A batch's columns of the result; c, level: count and level of each token and of the pair that it ends, end: the count of END."""
    base, model = log_probability(c, np.concatenate([[end], c[:-1]]), level, total, distinct, strength)
    first = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
    sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, model)]
    return [batch.column("doc_id"), pa.array(~np.asarray(batch.column("_train"))), pa.array(n_tokens, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(np.full(len(first), total), pa.int64()), pa.array(sums[1]), pa.array(sums[2])]


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, *, train: Column, text: str = "text", strength: float = 500.0, probes: tuple[int, int] = (10, 4), bits_per_probe: float = 2.0, segment_tokens: int = 500_000, most_broadcast: int = 400 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    Words and word pairs of the rows where train holds are counted exactly; pairs go by level into the filter. Word counts
    (12 bytes a distinct word) and filter are sent to all tasks if they are within most_broadcast bytes together; beyond
    that, what differs among the words and word pairs of a piece of the texts is sent, packed, to the filter's segments and
    probed there: the same filter, and the same scores.
    Null texts are empty texts, which have one token, their end; very long texts are scored whole; repeated rows each get
    their row (those with one id and text are of one piece); without training rows every probability is that of an unseen word, 1; other columns are not looked at.
    """
    d = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("_train"))
    small_batches(docs.sparkSession)
    size, rows = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    segments = max(4, -(-size // (6 * segment_tokens)))
    tables = count_tables(d.filter("_train").withColumn("text", F.coalesce("text", F.lit(""))), segments=segments, probes=probes, bits_per_probe=bits_per_probe)
    facts = tables.select("kind", "segment", "size", "total", F.octet_length("filter")).collect()
    distinct, total = (sum(r[i] for r in facts if r[0] == 1) for i in (2, 3))
    n_bytes = [0] * (segments if total else 0)
    for r in facts:
        if r[0] == 2:
            n_bytes[r[1]] = r[4]
    n_bytes = [max(1, x) for x in n_bytes]  # a segment without members has a byte of zeros
    if 12 * distinct + sum(n_bytes) > most_broadcast:
        return _score_routed(d, tables, segments, probes, total, distinct, strength, size + 64 * rows)

    h, n, bits = np.zeros(distinct, np.uint64), np.zeros(distinct, np.uint32 if total < 1 << 32 else np.int64), np.zeros(sum(n_bytes), np.uint8)
    starts, at = np.concatenate([[0], np.cumsum(n_bytes)]).astype(np.int64), 0
    for r in tables.select("kind", "segment", "h", "n", "filter").toLocalIterator():
        if r[0] == 1:
            part = np.frombuffer(r[2], np.uint64)
            h[at : at + len(part)], n[at : at + len(part)] = part, np.frombuffer(r[3], np.int64)
            at += len(part)
        else:
            bits[starts[r[1]] : starts[r[1]] + len(r[4])] = np.frombuffer(r[4], np.uint8)
    order = np.argsort(h)
    sent = docs.sparkSession.sparkContext.broadcast((h[order], n[order], LogFilter.laid_out(n_bytes, bits, probes)))
    del h, n, order, bits

    def rate(batches):
        known, count, held = sent.value
        for batch in pieces(batches, 4 << 20):
            token, n_tokens = text_tokens(batch)
            word, back = np.unique(token, return_inverse=True)
            c = counts_of(word, known, count)[back].astype(np.float64)
            end = float(count[np.searchsorted(known, END)]) if total else 0.0
            pair, which = np.unique(bigrams(token), return_inverse=True)
            yield pa.RecordBatch.from_arrays(scored(batch, n_tokens, c, end, held.levels(pair)[which], total, distinct, strength), RESULT)

    out = cut(d.mapInArrow(rate, _schema(docs)))
    sent.destroy()  # what was sent is held by driver and executors only until the scores are written
    return out


def _schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_routed(d: DataFrame, tables: DataFrame, segments: int, probes: tuple[int, int], total: int, distinct: int, strength: float, size: int, piece_bytes: int = 12 << 20) -> DataFrame:
    """The scores where filter and counts are too large to send: texts are dealt to pieces of about piece_bytes by their id
    and text; each piece sends the hashes that differ to their segments, packed and in order, and gets as many counts and
    levels back in that order, so that hashes and words don't travel again. Texts are shuffled once: both uses of the
    pieces are one exchange."""

    def in_order(all_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different hashes by segment and size, where segments begin, and where each token's hash is."""
        h, back = np.unique(all_, return_inverse=True)
        order, cuts = by_segment(segment_of(h, segments), segments)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return h[order], cuts, place[back]

    def ask(table):
        token, _ = text_tokens(table.combine_chunks().to_batches()[0])
        out = {"piece": [], "kind": [], "segment": [], "h": []}
        for kind, all_ in ((1, token), (2, bigrams(token))):
            h = np.unique(all_)
            order, cuts = by_segment(segment_of(h, segments), segments)
            h = h[order]
            for x in np.flatnonzero(np.diff(cuts)):
                for k, v in zip(out, (table.column("_piece")[0].as_py(), kind, int(x), pack(kind, h[cuts[x] : cuts[x + 1]])), strict=True):
                    out[k].append(v)
        return pa.table(out, pa.schema([("piece", pa.int64()), ("kind", pa.int32()), ("segment", pa.int32()), ("h", pa.binary())]))

    def answer(asked, made):
        said = []
        if asked.num_rows:
            kind = asked.column("kind")[0].as_py()
            h = [unpack(kind, x) for x in asked.column("h").to_pylist()]
            ends, h = np.cumsum([len(x) for x in h])[:-1], np.concatenate(h)
            found = np.zeros(len(h), np.uint8)
            for known, count, bits in zip(*(made.column(k).to_pylist() for k in ("h", "n", "filter")), strict=True):
                found = counts_of(h, np.frombuffer(known, np.uint64), np.frombuffer(count, np.int64)) if kind == 1 else LogFilter([bits], probes).levels(h)
            found = found.astype(np.uint8 if kind == 2 else np.uint32 if total < 1 << 32 else np.int64)
            said = [x.tobytes() for x in np.split(found, ends)]
        return pa.table({"piece": asked.column("piece"), "kind": asked.column("kind"), "segment": asked.column("segment"), "found": pa.array(said, pa.binary())})

    def rate(texts, answers):
        answers = answers.sort_by([("kind", "ascending"), ("segment", "ascending")])
        batch = texts.combine_chunks().to_batches()[0]
        token, n_tokens = text_tokens(batch)
        found = [b"".join(answers.filter(pa.compute.equal(answers.column("kind"), kind)).column("found").to_pylist()) for kind in (1, 2)]
        c = np.frombuffer(found[0], np.uint32 if total < 1 << 32 else np.int64)[in_order(token)[2]].astype(np.float64)
        level = np.frombuffer(found[1], np.uint8)[in_order(bigrams(token))[2]].astype(np.int64)
        end = c[n_tokens[0] - 1]  # every text ends with END
        return pa.Table.from_arrays(scored(batch, n_tokens, c, end, level, total, distinct, strength), RESULT)

    dealt = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_piece", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // piece_bytes)))))
    asked = dealt.groupBy("_piece").applyInArrow(ask, "piece long, kind int, segment int, h binary")
    answers = asked.groupBy("kind", "segment").cogroup(tables.groupBy("kind", "segment")).applyInArrow(answer, "piece long, kind int, segment int, found binary")
    return cut(dealt.groupBy("_piece").cogroup(answers.groupBy("piece")).applyInArrow(rate, _schema(d)))


def score_documents(docs: DataFrame) -> DataFrame:
    """documents scored by what the six sevenths of them say whose crc32(doc_id) mod 7 is not 2 (null ids are among them).

    Nulls, long and repeated texts and empty tables: as in score, whatever the columns' names.
    """
    docs, _ = sheltered(docs, "doc_id", "text")
    return score(docs, train=F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2)
