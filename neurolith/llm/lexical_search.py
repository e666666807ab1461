"""Ranked lexical search over inverted treaps: each term's postings are a tree that is a search tree by document and a heap by
impact, and all trees of a query are gone through together, without the subtrees that cannot reach the best k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import arrow_bytes, cut, mix, pieces, sent, sheltered, small_batches, words

#: What lies between terms: ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PIECE = 4 << 20
_NULL = np.iinfo(np.int64).max


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every term of the texts that lie end to end in data, and where each text's terms begin (one more)."""
    start, _, h = words(data, offsets, lower=True, gap=GAP)
    return h, np.searchsorted(start, offsets)


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting adds to a score, for each unit of its term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * length * n // max(1, total)))


class Treaps:
    """The treaps of some documents, numbered in the order of their ids: postings by term, then by document.

    Equal impacts are put in order by a hash of the posting, so that depths are logarithmic as those of random heaps. The
    parent of a posting is the lesser of its nearest greater neighbours in its term, which are found by doubling.
    """

    def __init__(self, term: np.ndarray, document: np.ndarray, unit: np.ndarray, n_terms: int, n_documents: int):
        n = len(term)
        self.document, self.unit, self.n, self.n_documents = np.append(document, -1), np.append(unit, 0), n, n_documents
        rank = np.append((unit << 24) + (mix(np.arange(n).astype(np.uint64)) & np.uint64(0xFFFFFF)).astype(np.int64), np.iinfo(np.int64).max)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        first = np.ones(n, bool)
        first[1:] = term[1:] != term[:-1]
        before[:-1][first] = n
        after[:-1][np.append(first[1:], True)[:n]] = n
        before[n] = after[n] = n
        for near, lower in ((before, np.less), (after, np.less_equal)):
            at = np.arange(n)
            while len(at):
                at = at[lower(rank[near[at]], rank[at])]
                near[at] = near[near[at]]
        self.left, self.right, self.root = np.full(n + 1, n), np.full(n + 1, n), np.full(n_terms, n)
        up = np.where(rank[before] < rank[after], before, after)[:n]
        own = np.arange(n)
        top, low, high = up == n, (up < n) & (own < up), (up < n) & (own > up)
        self.root[term[top]] = own[top]
        self.left[up[low]], self.right[up[high]] = own[low], own[high]
        order = np.argsort(document, kind="stable")
        self.by_document = (term[order], unit[order], np.searchsorted(document[order], np.arange(n_documents + 1)))

    def scores(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the ranges [low, high), and their scores by the weights of all terms."""
        term, unit, first = self.by_document
        n = high - low
        document = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        n = first[document + 1] - first[document]
        at = np.repeat(first[document] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return document, np.bincount(np.repeat(np.arange(len(document)), n), weights=weights[term[at]] * unit[at], minlength=len(document)).astype(np.int64)

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Down from each node to the top of its tree's part within [low, high)."""
        node = node.copy()
        row, column = np.nonzero(node < self.n)
        while len(row):
            here = node[row, column]
            before, after = self.document[here] < low[row], self.document[here] >= high[row]
            here = np.where(before, self.right[here], np.where(after, self.left[here], here))
            node[row, column] = here
            more = (before | after) & (here < self.n)
            row, column = row[more], column[more]
        return node

    def search(self, term: np.ndarray, weight_: np.ndarray, weights: np.ndarray, least: int, offer, *, leaf: int = 8, wave: int = 64) -> None:
        """Go through the trees of the terms together and offer (documents, scores) of all ranges that can reach `least`.

        A state is a range of documents with the top of each term's tree within it; the tops' impacts, weighted and added up,
        bound every score in the range. States are taken by the greatest bounds, a wave at a time; those below what offer
        returns as the least score to beat are gone. A state is split at the document of its heaviest top; short ranges are
        scored whole.
        """
        node = self.root[term][None, :]
        low, high = np.zeros(1, np.int64), np.full(1, self.n_documents)
        while True:
            bound = (self.unit[node] * weight_).sum(axis=1)
            live = (bound >= max(1, least)) & (high > low)
            node, low, high, bound = node[live], low[live], high[live], bound[live]
            if not len(bound):
                return
            take = np.argpartition(-bound, wave)[:wave] if len(bound) > wave else np.arange(len(bound))
            now, a, b = node[take], low[take], high[take]
            rest = np.ones(len(bound), bool)
            rest[take] = False
            node, low, high = node[rest], low[rest], high[rest]
            short = b - a <= leaf
            split = np.flatnonzero(~short)
            tops = now[split]
            pivot = self.document[tops[np.arange(len(split)), (self.unit[tops] * weight_).argmax(axis=1)]]
            least = offer(*self.scores(np.concatenate([a[short], pivot]), np.concatenate([b[short], pivot + 1]), weights))
            node = np.concatenate([node, self._within(tops, a[split], pivot), self._within(tops, pivot + 1, b[split])])
            low, high = np.concatenate([low, a[split], pivot + 1]), np.concatenate([high, pivot, b[split]])


def _count(h: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every posting of the vocabulary's terms, sorted by document and term."""
    if not len(h) or not len(vocabulary):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    held = np.flatnonzero(vocabulary[at] == h)
    document = np.searchsorted(first, held, "right") - 1
    both, tf = np.unique(document * len(vocabulary) + at[held], return_counts=True)
    return both // len(vocabulary), both % len(vocabulary), tf


def statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and how many documents hold each of the vocabulary's terms."""
    sent_ = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        for batch in pieces(batches, PIECE):
            h, first = terms(*arrow_bytes(batch.column("text")))
            term, df = np.unique(_count(h, first, sent_.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[(np.diff(first) > 0).sum(), len(h)], df]))], ["term", "n"])

    found = dict(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(len(vocabulary))], np.int64)


class Best:
    """The best k of what is offered for each query: greatest score, then least id (null ids last)."""

    def __init__(self, k: int, queries: int):
        self.k, self.kept = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries

    def offer(self, q: int, score: np.ndarray, id_: np.ndarray) -> int:
        score, id_ = np.concatenate([self.kept[q][0], score[score > 0]]), np.concatenate([self.kept[q][1], id_[score > 0]])
        order = np.lexsort((id_, -score))[: self.k]
        self.kept[q] = (score[order], id_[order])
        return self.least(q)

    def least(self, q: int) -> int:
        return int(self.kept[q][0][-1]) if len(self.kept[q][0]) == self.k else 1


def _search_block(docs: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, shard_bytes: int) -> DataFrame:
    """docs (doc_id, text), queries (number, hashes of its terms) -> (_item, doc_id, score): the best k of each task."""
    vocabulary = np.unique(np.concatenate([h for _, h in queries] or [np.zeros(0, np.uint64)])).astype(np.uint64)
    n, total, df = statistics(docs, vocabulary)
    w, asked = weight(n, df), []
    for number, h in queries:
        term, times = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
        times = times * w[term]
        asked.append((number, term[times > 0], times[times > 0]))
    sent_ = docs.sparkSession.sparkContext.broadcast((vocabulary, asked))

    def shards(batches) -> Iterator[tuple]:
        """Ids, lengths and postings of about shard_bytes of text at a time."""
        ids, lengths, postings, size, before = [], [], [], 0, 0
        for batch in pieces(batches, PIECE):
            data, offsets = arrow_bytes(batch.column("text"))
            h, first = terms(data, offsets)
            document, term, tf = _count(h, first, sent_.value[0])
            ids.append(batch.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy())
            lengths.append(np.diff(first))
            postings.append((document + before, term, tf))
            size, before = size + len(data), before + batch.num_rows
            if size >= shard_bytes:
                yield np.concatenate(ids), np.concatenate(lengths), *map(np.concatenate, zip(*postings, strict=True))
                ids, lengths, postings, size, before = [], [], [], 0, 0
        if ids:
            yield np.concatenate(ids), np.concatenate(lengths), *map(np.concatenate, zip(*postings, strict=True))

    def rank(batches):
        vocabulary, asked = sent_.value
        best = Best(k, len(asked))
        for ids, lengths, document, term, tf in shards(batches):
            place = np.empty(len(ids), np.int64)
            order = np.argsort(ids, kind="stable")
            place[order] = np.arange(len(ids))
            ids, unit, document = ids[order], impact(tf, lengths[document], n, total), place[document]
            order = np.lexsort((document, term))
            treaps = Treaps(term[order], document[order], unit[order], len(vocabulary), len(ids))
            weights = np.zeros(len(vocabulary), np.int64)
            for q, (_, own, times) in enumerate(asked):
                weights[own] = times
                treaps.search(own, times, weights, best.least(q), lambda at, score: best.offer(q, score, ids[at]))  # noqa: B023
                weights[own] = 0
        for (number, _, _), (score, id_) in zip(asked, best.kept, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), number)), pa.array(id_, mask=id_ == _NULL), pa.array(score)], ["_item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rank, "_item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, block_bytes: int = 16 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """docs (doc_id long, text), items (item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item.

    A task cuts what it reads into shards of about shard_bytes of text, builds the treaps of the terms that the items ask
    for, and carries each item's k-th best score on from shard to shard; the best k of each task are all that is shuffled.
    Items are taken in blocks, so that the texts of a block have about block_bytes (or are one item's); each block is
    searched by a scan of its own. Terms are taken as equal where 64-bit hashes of their lower-cased bytes are.
    Null and empty texts have no term: as documents they are never found, as items they find nothing. Every row of docs is a
    document of its own, repeated rows and rows that share an id too; equal scores go by ascending doc_id, null ids last.
    Repeated items count once; different texts under one id are ranked apart. Very long texts are taken whole; without
    documents or items there are no rows; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    docs, _ = sheltered(docs, "doc_id", "text")
    items, _ = sheltered(items, "item_id", "text")
    small_batches(spark)
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("_item", F.monotonically_increasing_id())
    items = cut(items)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-size // block_bytes)), None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).select("_item", "text").collect()
        raw = [r[1].encode() for r in own]
        h, first = terms(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64))
        found = _search_block(docs, [(r[0], h[first[i] : first[i + 1]]) for i, r in enumerate(own)], k, shard_bytes)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.join(sent(items.select("_item", "item_id")), "_item").select("item_id", "rank", "doc_id", "score")


def search_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 20 best documents of each benchmark item; nulls, ties, repeats, long texts and names as in ranked_search."""
    return ranked_search(docs, benchmark)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS terms FROM documents),
s AS (SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
p AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOW}, '{_TERM}') AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY item, term),
r AS (SELECT q.item, p.rid, CAST(sum(q.times * CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN s USING (rid) CROSS JOIN g GROUP BY q.item, p.rid),
o AS (SELECT r.item, doc_id, score, row_number() OVER (PARTITION BY r.item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r JOIN s USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i USING (item) WHERE rank <= 20"""
