"""N-gram Jaccard join: a forest of sorted MinHash prefixes proposes, exact shingle sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import MULT, arrow_bytes, cut, mix, pieces, sent, sheltered, small_batches, words
from neurolith.llm.components import components


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of the texts that lie end to end, and where each text's begin (one more than texts).

    A text of fewer words has one shingle, of all of them; one without words has none.
    """
    start, _, h = words(data, offsets)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(np.where(count >= n, count - n + 1, np.minimum(count, 1)), out=at[1:])
    text = np.repeat(np.arange(len(count)), np.diff(at))
    begin = first[text] + np.arange(at[-1]) - at[text]
    size = np.minimum(count[text], n)
    out = size.astype(np.uint64)
    for j in range(n):
        more = size > j
        out = np.where(more, mix(out * MULT + h[np.minimum(begin + j, max(0, len(h) - 1))]), out) if len(h) else out
    return out, at


def depth_for(similarity: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix, up to `deepest`, on which a pair of this similarity agrees in some tree with a chance of `recall`."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def depths(threshold: float, trees: int, deepest: int, recall: float, sizes: int = 40) -> np.ndarray:
    """How far a set of each size (0 to sizes, the last for all larger ones) has to shorten its prefixes.

    A set of m shingles cannot have every similarity: what counts is the least one at or above the threshold that some set
    can have to it. Sets of a few shingles link to nothing but sets of a high similarity and stay deep in their tries.
    """
    out = [deepest]
    for m in range(1, sizes):
        least = min(c / (m + b - c) for b in range(1, int(m / threshold) + 2) for c in range(1, min(m, b) + 1) if c / (m + b - c) >= threshold - 1e-9)
        out.append(depth_for(least, trees, deepest, recall))
    return np.array([*out, depth_for(threshold, trees, deepest, recall)], np.int8)


def signatures(h: np.ndarray, at: np.ndarray, trees: int, deepest: int) -> np.ndarray:
    """(texts with shingles, trees, deepest): the MinHash values of each text, 16 bits of each."""
    out = np.zeros((len(at) - 1, trees * deepest), ">u2")
    seeds = mix(np.arange(1, 2 * trees * deepest + 1, dtype=np.uint64) * MULT)
    for lo in range(0, len(at) - 1, 64):
        hi = min(lo + 64, len(at) - 1)
        part, begin = h[at[lo] : at[hi]], at[lo:hi] - at[lo]
        for i in range(trees * deepest):
            out[lo:hi, i] = mix(np.minimum.reduceat((part ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1)), begin)) >> np.uint64(48)
    return out.reshape(-1, trees, deepest)


def set_sizes(h: np.ndarray, at: np.ndarray, upto: int) -> np.ndarray:
    """The number of different shingles of each text; that of all shingles where these are more than upto times eight."""
    size = np.diff(at)
    small = np.flatnonzero((size > 0) & (size <= 8 * upto))
    if len(small):
        text = np.repeat(small, size[small])
        x = h[np.repeat(at[small], size[small]) + np.arange(len(text)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])]
        order = np.lexsort((x, text))
        x, text = x[order], text[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (text[1:] != text[:-1])])
        size = size.copy()
        size[small] = np.bincount(text[new], minlength=len(size))[small]
    return size


def met_in_trie(tree: np.ndarray, path: np.ndarray, own: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of a sorted run of a forest (tree, path and own depth of each text), for each depth the places whose text meets another.

    Common prefixes with the next path tell which neighbours share a node; a node of some depth counts if it holds a text
    that stops at this depth. Nodes that touch an edge of the run may go on beyond it and always count.
    """
    same = (path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.cumprod(same, axis=1).sum(axis=1)
    out = []
    for k in range(int(own.min()), path.shape[1] + 1):
        first = np.flatnonzero(np.concatenate([[True], lcp < k]))
        stops = np.logical_or.reduceat(own == k, first)
        size = np.diff(np.concatenate([first, [len(tree)]]))
        counts = stops & (size > 1)
        counts[[0, -1]] = True
        out.append((k, np.flatnonzero(np.repeat(counts, size))))
    return out


def met_before(a: np.ndarray, b: np.ndarray, tree: int, level: int, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
    """Which pairs of a and b (signatures) don't count in this node: those that belong to another depth, or met in an earlier tree."""
    out = np.minimum(own_a[:, None], own_b[None, :]) != level
    for t in range(tree):
        x, y = (np.ascontiguousarray(s[:, t, :level]).view(f"S{2 * level}").ravel() for s in (a, b))
        _, code = np.unique(np.concatenate([x, y]), return_inverse=True)
        out |= code[: len(x), None] == code[None, len(x) :]
    return out


def links_within(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """A boolean matrix of which sets of a and b have a Jaccard similarity of at least threshold (b None: a with itself)."""
    both = sets_a + (sets_b or [])
    size = np.array([len(x) for x in both], np.int64)
    owner = np.repeat(np.arange(len(both)), size)
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    na = len(sets_a)
    common = np.zeros((na, len(both) - na if sets_b else na), np.float32)
    new = np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((len(both), int(column[j - 1]) - lo + 1), np.float32)
        dense[owner[i:j], column[i:j] - lo] = 1
        common += dense[:na] @ (dense[na:].T if sets_b else dense.T)
    sa, sb = size[:na], size[na:] if sets_b else size[:na]
    # Whole numbers up to 2**24 are exact in single precision; larger sets would need more shared shingles than that.
    linked = common.astype(np.float64) >= threshold * (sa[:, None] + sb[None, :] - common.astype(np.float64)) - 1e-9
    if not sets_b:
        np.fill_diagonal(linked, False)
    return linked & (sa[:, None] > 0)


def jaccard_join(docs: DataFrame, *, text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9998, trees: int = 24, deepest: int = 7, block: int = 1_000, shingles_per_block: int = 4_000_000, rows_per_run: int = 2_000_000, whole_up_to: float = 1.0, keep_key: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, class_id, copy_id, n_links.

    Texts link if their sets of n-word shingles have a Jaccard similarity of at least threshold. Equal texts are one; n_links
    counts the different texts that a text links to, copy_id is the least doc_id of its copies and class_id that of all
    texts that links reach from it.

    Each different text has a path of `deepest` MinHash values in each tree of a forest. The paths of all trees are sorted by
    ranges, which makes each tree a prefix trie in order; a hot node simply spans several ranges. Within a range each text
    shortens its prefix until a pair of the least similarity that links can have with a set of its size shares a node with it
    in some tree with a chance of `recall`. Texts that share a node are tied to the least of it; what ties connect are
    candidates.

    Exact sets then decide, in blocks of at most about `block` texts and shingles_per_block shingles, inside tasks that
    return one row per text: no pair is ever a row, and a huge group is many bounded tasks. A group of candidates is compared
    as a whole where this copies fewer sets than comparing node by node does (whole_up_to times as many), as with near
    copies of one text; a group that chance ties chain together is compared within its nodes only, each pair in the first
    node where it meets.

    Texts of fewer than n words have one shingle of all their words; texts without words and nulls link to nothing and are
    classes of their own copies; very long texts count whole; repeated rows are copies; null ids are kept (and never the
    least id where others are there); an empty table gives an empty result; other columns, whatever their names, are not
    looked at. keep_key adds text_key, the text's MD5.
    """
    stops = depths(threshold, trees, deepest, recall)
    own_depth = lambda size: stops[np.minimum(size, len(stops) - 1)]
    width = 2 * deepest
    docs, _ = sheltered(docs, "doc_id", text)
    kind = dict(docs.dtypes)["doc_id"]
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in pieces(batches, 4 << 20):
            h, at = shingles(*arrow_bytes(batch.column("text")), n)
            some = np.diff(at) > 0
            made = signatures(h, np.concatenate([at[:-1][some], at[-1:]]), trees, deepest)
            out = np.full(len(some), None, object)
            out[some] = [x.tobytes() for x in made]
            size = set_sizes(h, at, len(stops))
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "text_key"]).columns, pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "text_key", "size", "signature"])

    def paths(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                data, _ = arrow_bytes(part.column("signature"))
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), part.num_rows * trees, [None, pa.py_buffer(data.tobytes())])
                row = pa.array(np.repeat(np.arange(part.num_rows), trees))
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                own = own_depth(np.asarray(part.column("size")))
                yield pa.RecordBatch.from_arrays([pa.array(tree), fixed.cast(pa.binary()), part.column("text_key").take(row), pa.array(np.repeat(own, trees).astype(np.int32))], ["tree", "path", "text_key", "own"])

    def meet(batches):
        t = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        path = np.frombuffer(arrow_bytes(t.column("path").chunk(0))[0].tobytes(), ">u2").reshape(-1, deepest)
        for k, at in met_in_trie(t.column("tree").to_numpy(), path, t.column("own").to_numpy()):
            for i in range(0, len(at), 65_536):
                some = at[i : i + 65_536]
                node = np.ascontiguousarray(path[some, :k])
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * k), len(some), [None, pa.py_buffer(node.tobytes())])
                rows = pa.array(some)
                yield pa.RecordBatch.from_arrays([t.column("tree").take(rows).chunk(0), fixed.cast(pa.binary()), t.column("text_key").take(rows).chunk(0)], ["tree", "node", "text_key"])

    d = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    text_key = F.unhex(F.md5("text"))
    signed = cut(d.select("doc_id", text_key.alias("text_key"), "text").mapInArrow(sign, f"doc_id {kind}, text_key binary, size long, signature binary"))
    texts = cut(signed.groupBy("text_key").agg(F.min("doc_id").alias("copy_id"), F.first("size").alias("size"), F.first("signature").alias("signature")))
    forest = texts.filter("signature IS NOT NULL").select("text_key", "size", "signature")
    runs = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() * trees // rows_per_run))
    forest = forest.mapInArrow(paths, "tree int, path binary, text_key binary, own int").repartitionByRange(runs, "tree", "path", "text_key").sortWithinPartitions("tree", "path", "text_key")
    # Written first, here and below: then a join's sides are plain shuffles, and adaptive execution can split a hot key.
    met = cut(forest.mapInArrow(meet, "tree int, node binary, text_key binary"))
    nodes = cut(met.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("text_key").alias("least")).filter("n > 1"))
    ties = met.join(nodes, ["tree", "node"]).filter("text_key <> least").select(F.col("text_key").alias("a"), F.col("least").alias("b")).distinct()
    members = cut(components(ties).withColumnRenamed("node", "text_key").join(texts.select("text_key", "copy_id", "size", "signature"), "text_key"))

    blocks_of = lambda count, size: F.greatest(F.lit(1), F.ceil(count / F.lit(block)), F.ceil(size / F.lit(shingles_per_block))).cast("int")
    copies = lambda blocks, count: blocks.cast("double") * count
    in_node = cut(met.join(members.select("text_key", "label", "size"), "text_key"))
    in_nodes = in_node.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"), F.min("label").alias("label")).filter("_n > 1")
    in_nodes = cut(in_nodes.select("tree", "node", "label", blocks_of(F.col("_n"), F.col("_s")).alias("blocks"), "_n"))
    by_node = in_nodes.groupBy("label").agg(F.sum(copies(F.col("blocks"), F.col("_n"))).alias("_by_node"))
    groups = members.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s"))
    groups = groups.withColumn("blocks", blocks_of(F.col("_n"), F.col("_s"))).join(by_node, "label", "left")
    groups = cut(groups.select("label", "blocks", (copies(F.col("blocks"), F.col("_n")) <= whole_up_to * F.coalesce("_by_node", F.lit(0.0))).alias("whole")))
    n_members, n_shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    # Places where a text is compared: its group as a whole, or each of its nodes. No signature is needed in a whole group.
    whole = members.join(groups.filter("whole").select("label", "blocks"), "label").select("text_key", "copy_id", F.col("label").alias("place"), "blocks", F.lit(-1).alias("tree"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("signature"))
    apart = members.join(groups.filter("NOT whole").select("label"), "label", "left_semi").select("text_key", "copy_id", "signature").join(in_node.select("text_key", "tree", "node"), "text_key").join(in_nodes.select("tree", "node", "blocks"), ["tree", "node"])
    apart = apart.select("text_key", "copy_id", F.unhex(F.sha2(F.concat(F.col("tree").cast("string").cast("binary"), "node"), 256)).alias("place"), "blocks", "tree", (F.octet_length("node") / 2).cast("int").alias("level"), "signature")
    places = whole.unionByName(apart).groupBy("text_key").agg(F.first("copy_id").alias("_id"), F.collect_list(F.struct("place", "blocks", "tree", "level", "signature")).alias("places"))
    places = cut(places)

    def to_set(batches):
        seen = set()  # repeated rows and null ids: one of each text in a partition will do
        for batch in pieces(batches, 4 << 20):
            keys = batch.column("text_key").to_pylist()
            some = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if not some:
                continue
            batch = batch.take(pa.array(some))
            h, at = shingles(*arrow_bytes(batch.column("text")), n)
            sets = [np.unique(h[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["text_key", "places"]).columns, pa.array(sets, pa.large_binary()).cast(pa.binary())], ["text_key", "places", "set"])

    # One row for each text: that of its least doc_id.
    found = d.withColumn("text_key", text_key).join(sent(places), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("text_key", "places", "text")
    sets = found.mapInArrow(to_set, f"text_key binary, places {dict(places.dtypes)['places']}, set binary")
    sets = sets.select("text_key", F.explode("places").alias("p"), "set").select("text_key", "p.*", "set")
    buckets = max(1, -(-n_members // (4 * block)), -(-int(n_shingles) // shingles_per_block))
    own = F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")
    small = F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("string").cast("binary")
    sets = sets.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select(F.when(F.col("blocks") == 1, small).otherwise(F.col("place")).alias("group"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "place", "tree", "level", "text_key", "signature", "set")

    def decide(key, table):
        t = table.to_pandas().drop_duplicates(["place", "text_key"])
        out = []
        for _, g in t.groupby("place", sort=False):
            keys = g.text_key.to_numpy()
            each = [np.frombuffer(x, np.uint64) for x in g.set]
            i, j = key[1].as_py(), key[2].as_py()
            a, b = (np.flatnonzero((g.own == x).to_numpy()) for x in (i, j))
            linked = np.zeros((len(each), len(each)), bool)
            if len(a) and len(b):
                part = links_within([each[x] for x in a], None if i == j else [each[x] for x in b], threshold)
                tree, level = int(g.tree.iloc[0]), int(g.level.iloc[0])
                if tree >= 0:
                    signs = np.stack([np.frombuffer(x, ">u2").reshape(trees, deepest) for x in g.signature])
                    depth = own_depth(np.array([len(x) for x in each]))
                    part &= ~met_before(signs[a], signs[b], tree, level, depth[a], depth[b])
                linked[np.ix_(a, b)] = part
                linked |= linked.T
            n_links = linked.sum(axis=1)
            least = np.arange(len(keys))
            while True:  # the least place among all that links reach
                new = np.minimum(least, np.where(linked, least[None, :], len(keys)).min(axis=1, initial=len(keys)))
                new = new[new]
                if (new == least).all():
                    break
                least = new
            some = np.flatnonzero(n_links)
            out += [(keys[x], keys[least[x]], int(n_links[x])) for x in some]
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary()), "links": pa.array([x[2] for x in out], pa.int64())})

    decided = cut(sets.groupBy("group", "i", "j").applyInArrow(decide, "a binary, b binary, links long"))
    classes = components(decided.select("a", "b"))
    links = decided.groupBy(F.col("a").alias("text_key")).agg(F.sum("links").alias("n_links"))
    linked = cut(links.join(classes.withColumnRenamed("node", "text_key"), "text_key").join(members.select("text_key", "copy_id"), "text_key"))
    least = cut(linked.groupBy("label").agg(F.min("copy_id").alias("class_id")))
    linked = cut(linked.join(least, "label").select("text_key", "class_id", "n_links"))
    of_text = texts.select("text_key", "copy_id").join(linked, "text_key", "left")
    of_text = of_text.select("text_key", F.when(F.col("n_links").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), "copy_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("doc_id", "text_key").join(of_text, "text_key").select("doc_id", "class_id", "copy_id", "n_links", *(["text_key"] if keep_key else []))


def join_documents(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)


def keep_first(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each class; the columns as they are, whatever their names.

    Of texts without words one copy of each stays. Repeated rows become one. Rows with a null id stay only where their class
    has no other id, one for each text. An empty table gives an empty one. The rows to drop are few: their keys are sent to
    the texts where they are small enough together, and joined by a shuffle beyond.
    """
    d, back = sheltered(docs, "doc_id", "text")
    classes = cut(jaccard_join(d, keep_key=True))
    gone = cut(classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), "text_key").distinct())
    left = d.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    left = left.join(sent(gone), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("text_key")), "left_anti")
    repeated = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["doc_id", "_key"])
    return back(left)
