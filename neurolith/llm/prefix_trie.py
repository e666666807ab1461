"""The prefix trie of all conversations, family first: conversations are cogrouped with their base, rebuilt and combined in
the family's small trie, and only the combined nodes are shuffled for the global one."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import cut, mix, sheltered

FAMILY, HEADS = 5, 9
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
KEY = ["depth", "ka", "kb"]


def head(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def lanes(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each turn at its depth; those of the first d turns, xored, are the key of a depth-d node."""
    at, a, b = depth.astype(np.uint64), a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    return mix(mix(a + at * _A) ^ b), mix(mix(b + at * _B) + a)


def turns(conversations: DataFrame) -> DataFrame:
    """conversations -> (base, conv_id, turn, a, b, size, piece): 120 bits of each turn's digest in the place of its text,
    sorted by ranges of (base, conversation, turn), each of which is a piece; equal rows spread over pieces too."""
    c, _ = sheltered(conversations, "conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    word = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    c = c.filter("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "conv_id", "turn", word(1).alias("a"), word(16).alias("b"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row"))
    c = c.repartitionByRange("base", "conv_id", F.asc_nulls_first("turn"), "a", "b", "_row").drop("_row")
    return cut(c.withColumn("piece", F.spark_partition_id()))


def _in_order(table: pa.Table) -> pa.Table:
    """By conversation and turn (null first), ties by digest."""
    turn = table.column("turn")
    return table.append_column("_known", turn.is_valid()).sort_by([("conv_id", "ascending"), ("_known", "ascending"), ("turn", "ascending"), ("a", "ascending"), ("b", "ascending")])


def _words(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _starts(t: DataFrame, heads: DataFrame) -> DataFrame:
    """(piece, conv_id, before, xa, xb, ends) of the conversations that lie in several pieces: turns of their own before the
    piece, the key of those that count, and whether the piece is the last.

    At most one conversation goes on from a piece to the next, so there are fewer rows than pieces, twice.
    """
    spark = t.sparkSession
    edge = t.groupBy("piece").agg(F.min(F.struct("base", "conv_id")).alias("low"), F.max(F.struct("base", "conv_id")).alias("high")).orderBy("piece").collect()
    going = sorted({tuple(x.high) for x, y in zip(edge, edge[1:], strict=False) if x.high == y.low})
    schema = "piece int, conv_id long, before long, xa long, xb long, ends boolean"
    if not going:
        return spark.createDataFrame([], schema)
    own = t.join(F.broadcast(spark.createDataFrame([(c,) for _, c in going], "conv_id long")), "conv_id")
    size = dict(heads.join(F.broadcast(spark.createDataFrame([(b,) for b in {b for b, _ in going}], "base long")), "base").groupBy("base").count().collect())
    taken = {c: min(head(c), size.get(b, 0)) for b, c in going}
    counts: dict[int, list] = {}
    for conv, piece, n in own.groupBy("conv_id", "piece").count().orderBy("conv_id", "piece").collect():
        counts.setdefault(conv, []).append((piece, n))
    before = {(conv, p): sum(n for _, n in ps[:i]) for conv, ps in counts.items() for i, (p, _) in enumerate(ps)}

    def add_up(key, table):
        table = _in_order(table)
        conv, piece = key[0].as_py(), key[1].as_py()
        at = before[conv, piece] + 1 + np.arange(table.num_rows)
        a, b = _words(table, "a", "b")
        past = at > head(conv)
        x, y = lanes((taken[conv] + at - head(conv))[past], a[past], b[past])
        return pa.table({"conv_id": [conv], "piece": pa.array([piece], pa.int32()), "xa": np.bitwise_xor.reduce(x, keepdims=True).view(np.int64), "xb": np.bitwise_xor.reduce(y, keepdims=True).view(np.int64)})

    part = {(r[0], r[1]): (r[2], r[3]) for r in own.groupBy("conv_id", "piece").applyInArrow(add_up, "conv_id long, piece int, xa long, xb long").collect()}
    rows = []
    for conv, ps in counts.items():
        xa = xb = 0
        for piece, _ in ps:
            rows.append((piece, conv, before[conv, piece], xa, xb, piece == ps[-1][0]))
            xa, xb = xa ^ part[conv, piece][0], xb ^ part[conv, piece][1]
    return spark.createDataFrame(rows, schema)


_NODE = "depth long, ka long, kb long, pa long, pb long, conv_id long, n_convs long, size long, ends array<long>"


def _family(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Neighbouring families' parts of a piece (left) and the first turns of their bases (right) -> their combined nodes."""
    nodes: dict[tuple, list] = {}
    of, *first = _words(right.sort_by([("base", "ascending"), ("place", "ascending")]), "base", "a", "b", "size")
    left = _in_order(left)
    base, conv, a, b, size, before, xa, xb = _words(left, "base", "conv_id", "a", "b", "size", "before", "xa", "xb")
    last = left.column("ends").to_pylist()
    edges = [*np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])).tolist(), len(conv)]
    for i, j in zip(edges, edges[1:], strict=False):
        c, off = int(conv[i]), int(before[i])
        h = head(c)
        own_base = slice(*np.searchsorted(of, [base[i], base[i] + 1]))
        h_a, h_b, h_size = (x[own_base] for x in first)
        n_head, skip = min(h, len(h_a)), min(max(0, h - off), j - i)
        x, y = lanes(1 + np.arange(n_head), h_a[:n_head], h_b[:n_head])
        x, y = np.bitwise_xor.accumulate(x), np.bitwise_xor.accumulate(y)
        start = (int(x[-1]), int(y[-1])) if n_head else (0, 0)
        start = (np.uint64(start[0]) ^ np.uint64(xa[i].view(np.uint64)), np.uint64(start[1]) ^ np.uint64(xb[i].view(np.uint64)))
        depth = n_head + off + 1 - h + np.arange(skip, j - i)
        u, v = lanes(depth, a[i + skip : j], b[i + skip : j])
        u, v = np.bitwise_xor.accumulate(np.concatenate([[start[0]], u])), np.bitwise_xor.accumulate(np.concatenate([[start[1]], v]))
        level, own = depth, (u[1:], v[1:], u[:-1], v[:-1], size[i + skip : j])
        if off == 0:
            zero = np.zeros(1, np.uint64)
            x, y = np.concatenate([zero, x]), np.concatenate([zero, y])
            level = np.concatenate([np.arange(n_head + 1), depth])
            own = tuple(np.concatenate(z) for z in zip((x, y, np.concatenate([zero, x[:-1]]), np.concatenate([zero, y[:-1]]), np.concatenate([[0], h_size[:n_head]])), own, strict=True))
        words_ = [z.view(np.int64).tolist() if z.dtype == np.uint64 else z.astype(np.int64).tolist() for z in own]
        for d, ka, kb, p, q, s in zip(level.tolist(), *words_, strict=True):
            node = nodes.setdefault((d, ka, kb), [p, q, c, 0, s, []])
            node[2], node[3] = min(node[2], c), node[3] + 1
        if last[i]:
            d = int(depth[-1]) if len(depth) else max(n_head, n_head + off - h)
            nodes.setdefault((d, int(u[-1].view(np.int64)), int(v[-1].view(np.int64))), [None, None, c, 0, None, []])[5].append(c)
    rows = [[*k, *v] for k, v in nodes.items()]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    return pa.table([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=[x.split()[0] for x in _NODE.split(", ")])


def family_nodes(conversations: DataFrame, together: int = 64) -> DataFrame:
    """conversations -> the combined nodes of the families (of each piece, if a family's turns lie in several).

    Conversations meet with their bases by base id, so many neighbouring ids in one call.
    """
    t = turns(conversations)
    first = Window.partitionBy("base").orderBy(F.asc_nulls_first("turn"), "a", "b")
    heads = t.filter("conv_id = base").withColumn("place", F.row_number().over(first)).filter(F.col("place") < HEADS).select("base", "place", "a", "b", "size")
    heads = cut(heads)
    starts = F.broadcast(_starts(t, heads))  # fewer rows than two for each piece
    left = t.join(starts, ["piece", "conv_id"], "left").select("base", "piece", "conv_id", "turn", "a", "b", "size", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("before", "xa", "xb")), F.coalesce("ends", F.lit(True)).alias("ends"))
    right = heads.join(t.select("base", "piece").distinct(), "base").select(F.col("base").alias("base"), F.col("piece").alias("part"), "place", "a", "b", "size")
    block = F.floor(F.col("base") / (FAMILY * together)).alias("block")
    return cut(left.groupBy(block, "piece").cogroup(right.groupBy(block, "part")).applyInArrow(_family, _NODE))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, conv_id) -> (depth, ka, kb, ends_sha256): ids in order, joined by commas.

    Ids are sorted by ranges, so those of one node may lie in many partitions, which join theirs in chunks; a node's chunks
    then go through its hash one after the other, without being held together.
    """

    def chunks(batches):
        for batch in batches:
            depth, a, b, conv = (batch.column(i).to_numpy() for i in range(4))
            edges = [*np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1])])).tolist(), len(a)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(edges[:-1], pa.int64())) for k in range(4)), pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in zip(edges, edges[1:], strict=False)], pa.string())], ["depth", "ka", "kb", "conv_id", "chunk"])

    def hashed(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for *key, _, chunk in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(chunk.encode())
                else:
                    digest.update(b"," + chunk.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r, strict=True)) for r in out], schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], (*now, digest.hexdigest()), strict=True))], schema=kind)

    kind = pa.schema([("depth", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
    ranged = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").select(*KEY, "conv_id")
    made = ranged.mapInArrow(chunks, "depth long, ka long, kb long, conv_id long, chunk string")
    made = made.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return made.mapInArrow(hashed, "depth long, ka long, kb long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, leaf, saved) -> (conv_id, depth, n_leaves, saved_tokens), the root left out.

    In round j every node that lies deeper sends what it has gathered to its ancestor 2^j above, by partial sums; so rounds
    grow with the logarithm of the depth, and after three of them only conversations of over eight turns go on.
    """
    all_ = nodes.filter("depth > 0")
    sums = [all_.select("conv_id", "depth", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))]
    live = all_.filter("depth > 1").select("conv_id", "depth", F.col("parent_conv_id").alias("up"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step = 1
    while not live.isEmpty():
        live = cut(live)
        add = cut(live.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        sums.append(add)
        deep = live.filter(F.col("depth") > 2 * step)
        above = live.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("_up"))
        more = add.toDF("conv_id", "depth", "_leaves", "_saved")
        deep = deep.join(above, ["up", "depth"]).join(more, ["conv_id", "depth"], "left")
        live = deep.select("conv_id", "depth", F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))
        step *= 2
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id long, turn, role, text) -> a row for each node of the trie of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256.
    Turns are in the order of turn, null first, ties by their digests; null role or text is empty. Repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out. Very long texts count whole; conversations
    of any length are cut between pieces, so that no task takes one whole. Turns are taken as equal where 120 bits of the
    SHA-256 of role and text are. An empty table has no members and gives no row, not even a root; other columns, whatever
    their names, are not looked at.
    """
    fam = family_nodes(conversations)
    nodes = fam.groupBy(*KEY).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.coalesce(F.max("size"), F.lit(0)).alias("size"))
    nodes = cut(nodes)
    of_parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    children = nodes.filter("depth > 0").groupBy(*of_parent).agg(F.count(F.lit(1)).alias("n_children"))
    root = nodes.filter("depth = 0").select("conv_id").first()
    parents = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("_parent"))
    deep = nodes.filter("depth > 1").join(parents, ["depth", "pa", "pb"])
    top = nodes.filter("depth <= 1").withColumn("_parent", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")))
    nodes = deep.unionByName(top).join(children, KEY, "left")
    nodes = cut(nodes.select(*KEY, "conv_id", F.col("_parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    sums = _subtree_sums(nodes)
    total = nodes.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).withColumn("depth", F.lit(0).cast("long")).withColumn("conv_id", F.lit(root[0] if root else None).cast("long"))
    sums = sums.unionByName(total.select("conv_id", "depth", "n_leaves", "saved_tokens"))
    ends = _digests(fam.select(*KEY, F.explode("ends").alias("conv_id")))
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (SELECT conv_id AS c, size_, turn, sha, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS p FROM (
      SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size_, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha
      FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda r, x: list_reduce(list_prepend(xor(r, x), [CAST(1 AS BIGINT)] || [1, 1, 1, 1, 1, 1, 1]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.sha, t.size_, 0 AS part, t.p FROM c JOIN t ON t.c = c.c - c.c % {FAMILY} AND t.p <= c.h
      UNION ALL SELECT c.c, t.sha, t.size_, 1, t.p FROM c JOIN t ON t.c = c.c AND t.p > c.h),
o AS (SELECT c, sha, size_, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM r),
m AS (SELECT c, d, size_, string_agg(sha, '') OVER (PARTITION BY c ORDER BY d) AS k FROM o UNION ALL SELECT c, 0, 0, '' FROM c),
z AS (SELECT c, max(d) AS last FROM m GROUP BY c),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(size_) AS size_, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last) AS ends FROM m JOIN z USING (c) GROUP BY k, d),
q AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON n.d = u.d + 1 AND u.k = substr(n.k, 1, 64 * (n.d - 1))),
e AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM q WHERE d > 0 GROUP BY ALL),
x AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN e USING (conv_id, d)),
s AS (SELECT m.k, m.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.size_) AS saved_tokens
      FROM x JOIN m ON m.c = x.conv_id AND m.d <= x.d GROUP BY m.k, m.d)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM x JOIN s USING (k, d)"""
