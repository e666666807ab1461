"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import cut, sheltered, small_batches

#: Rounding of chord distances between unit vectors; pruning and ties allow for it.
SLACK = 1e-7


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is from 1/2 to 1: no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def build_tree(points: np.ndarray, leaf: int, seed: int = 5) -> dict[str, np.ndarray]:
    """The tree over unit vectors: each inner node has a vantage point and the median chord distance to it.

    order: points so that every node is a run [start, stop); the vantage point comes first, then the nearer half, then the
    farther one. nodes: rows (start, stop, inside child, outside child), children -1 in a leaf. radius: the medians.
    """
    rng = np.random.default_rng(seed)
    order = np.arange(len(points))
    nodes, radius, stack = [], [], [(0, len(points), -1, 0)]
    while stack:
        start, stop, parent, side = stack.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([start, stop, -1, -1])
        radius.append(0.0)
        if stop - start <= leaf:
            continue
        at = start + int(rng.integers(stop - start))
        order[start], order[at] = order[at], order[start]
        rest = order[start + 1 : stop]
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[rest] @ points[order[start]])))
        half = len(rest) // 2
        split = np.argpartition(far, half)
        radius[-1] = float(far[split[half]])
        order[start + 1 : stop] = rest[split]
        stack += [(start + 1 + half, stop, len(nodes) - 1, 1), (start + 1, start + 1 + half, len(nodes) - 1, 0)]
    return {"order": order, "nodes": np.array(nodes, np.int64).reshape(-1, 4), "radius": np.array(radius)}


def search_tree(tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, point) of all points that may be among the k nearest of a query, by the larger cosine.

    A subtree is left out for a query if its least possible chord distance times factor is over that of the k-th best so
    far. factor 1 is exact; a larger one prunes more.
    """
    order, nodes, radius = tree["order"], tree["nodes"], tree["radius"]
    best = np.full((len(queries), k), -np.inf)
    found_q, found_p, found_c = [], [], []

    def take(active: np.ndarray, run: np.ndarray) -> np.ndarray:
        cos = queries[active] @ points[run].T
        seen = np.where(ids[run][None, :] == query_ids[active][:, None], -np.inf, cos)
        merged = np.concatenate([best[active], seen], axis=1)
        best[active] = -np.partition(-merged, k - 1, axis=1)[:, :k]
        a, p = np.nonzero((seen >= best[active].min(axis=1)[:, None] - SLACK) & (seen > -np.inf))
        found_q.append(active[a])
        found_p.append(run[p])
        found_c.append(seen[a, p])
        return cos

    def reach(active: np.ndarray) -> np.ndarray:
        worst = best[active].min(axis=1)
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.where(np.isfinite(worst), worst, -1.0)))

    # A visit: node, queries, and their least possible distance to what it holds.
    stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))] if len(nodes) and len(queries) else []
    while stack:
        node, active, bound = stack.pop()
        still = bound * factor <= reach(active) + SLACK
        active = active[still]
        if not len(active):
            continue
        start, stop, inside, outside = nodes[node]
        if inside < 0 and outside < 0:
            take(active, order[start:stop])
            continue
        cos = take(active, order[start : start + 1])[:, 0]
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos)) - radius[node]
        near = gap <= 0
        # The nearer child comes first; the other waits on the stack and is judged again when its turn comes.
        stack += [(outside, active[near], -gap[near]), (inside, active[~near], gap[~near]), (outside, active[~near], np.zeros((~near).sum())), (inside, active[near], np.zeros(near.sum()))]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, p, c = map(np.concatenate, (found_q, found_p, found_c))
    keep = c >= best.min(axis=1)[q] - SLACK
    return q[keep], p[keep]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a and b in double precision, the sums taken in order; of any finite size, since powers of two change no digit."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def _pack(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def vp_search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0, rows_per_shard: int = 10_000, queries_per_block: int = 2_000, leaf: int = 128) -> DataFrame:
    """The k nearest vectors of each query by cosine: query_id, rank, vec_id, score.

    vectors and queries: vec_id long, embedding array of numbers. Rows are hashed to shards of about rows_per_shard, each
    with a tree of its own (one packed row, written to the shared folder). Each shard is one task, which reads its tree once
    and then takes the queries in blocks of about queries_per_block, one after the other; the shards' answers meet in one
    top-k per query. No task holds more than a shard and a block. factor 1 is exact; a larger one prunes more and may miss
    neighbours. Of equal vectors only the k + 1 least ids are indexed, since no others can be in an answer; a group limit
    before the shuffle finds them.

    Vectors that are null, empty or zero, or that hold null or non-finite components, take no part, on either side; vectors
    of another length than a query are not its candidates; finite components may be of any size. A row is known by its
    vec_id: rows with the query's own id are that query and not its candidates, and a row that occurs twice, id and vector,
    is one candidate, as it could take but one rank by the tie rule. Ties go to the smaller id; null ids take no part; empty
    tables give an empty result; other columns, whatever their names, are not looked at.
    """
    small_batches(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    good = lambda d: sheltered(d, "vec_id", "embedding")[0].select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    indexed = cut(good(vectors).distinct().withColumn("copy", copy).filter(F.col("copy") <= k + 1).drop("copy").withColumn("dim", F.size("embedding")))
    shards = max(1, -(-indexed.count() // rows_per_shard))
    indexed = indexed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(key, rows):
        rows = rows.sort_values("vec_id")
        points, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy(np.int64)
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "tree": [_pack(points=points, ids=ids, **build_tree(unit(points), leaf))]})

    trees = cut(indexed.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, tree binary"))
    q = cut(good(queries).distinct().withColumn("dim", F.size("embedding")))
    blocks = max(1, -(-q.count() // queries_per_block))

    def block(key, rows):
        return pd.DataFrame({"dim": [key[1]], "block": [key[0]], "queries": [_pack(vectors=np.array(rows.embedding.tolist(), np.float64), ids=rows.vec_id.to_numpy(np.int64))]})

    q = cut(q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInPandas(block, "dim int, block int, queries binary"))
    asked = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "dim", "block", F.col("queries").alias("body"))
    held = trees.select("shard", "dim", F.lit(-1).alias("block"), F.col("tree").alias("body"))

    def search(batches):
        at, t, p = None, None, None
        for batch in batches:
            for shard, dim, block, body in batch.itertuples(index=False):
                if block < 0:  # a shard's tree of a length comes before all queries of that length
                    at, t = (shard, dim), _unpack(body)
                    p = unit(t["points"])
                elif at == (shard, dim):
                    a = _unpack(body)
                    found, near = search_tree(t, p, t["ids"], unit(a["vectors"]), a["ids"], k, factor)
                    yield pd.DataFrame({"query_id": a["ids"][found], "vec_id": t["ids"][near], "score": cosine(a["vectors"][found], t["points"][near])})

    hits = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "block").mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """Every vector whose id 50 divides against all, with the exact factor. Nulls, ties and repeats: as in vp_search."""
    return vp_search(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
