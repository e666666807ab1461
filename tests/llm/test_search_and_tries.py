"""Line dedup, ranked lexical search and the prefix trie against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from neurolith.llm import lexical_search, line_dedup, prefix_trie

DOCS = "doc_id long, text string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def vocabulary(rng: random.Random, n: int = 200) -> list[str]:
    return ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(n)]


def line_docs() -> list[tuple]:
    rng = random.Random(3)
    v = vocabulary(rng)
    line = lambda n=12: " ".join(rng.choices(v, k=n))
    notice, four, short = "This text MAY be copied Freely by all, é à ü ok.", line(14), "too short a line"
    rows = []
    for i in range(60):
        own = [line() for _ in range(rng.randint(0, 6))]
        if i % 2:
            own += ["  " + (notice if i % 4 == 1 else notice.lower()) + "\t\r"] * (1 + i % 3)
        if i in (5, 9, 20, 41):
            own.insert(0, four)
        own.append(short)
        rng.shuffle(own)
        rows.append((i, "\n".join(own), "s"))
    rows += [(60, None, None), (61, "", "s"), (62, "\n", "s"), (63, "\n\n" + notice + "\n", "s"), (64, "é" * 39, "s"), (65, "é" * 100000 + "\n" + notice, "s"), (None, notice + "\nmine", "s"), (None, notice, "s"), (63, "\n\n" + notice + "\n", "s")]
    return [*rows, *[(70 + i, "A copied document's only line, as long as it has to be.\n\nx", "s") for i in range(6)]]


def lines_kept(rows: list[tuple], least: int = 5) -> collections.Counter:
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOW)
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(doc)
    keeper = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(h) >= least}
    out = collections.Counter()
    for doc, text, *_ in rows:
        all_ = (text or "").split("\n")
        left = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == doc]
        out[doc, len(all_), len(all_) - len(left), "\n".join(left)] += 1
    return out


@pytest.mark.parametrize("bound", [256 << 20, 0, 40], ids=["sent", "routed", "mixed"])
def test_line_dedup_is_brute_force_on_every_path(spark, bound):
    rows = line_docs()
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(5), most_broadcast=bound)
    assert got.columns == ["doc_id", "text", "source", "kept_text", "n_lines", "n_dropped"]
    got = got.collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in got) == lines_kept(rows)
    assert all(r.kept_text is None for r in got if r.text is None)


def test_line_dedup_query_and_empty_table(spark):
    rows = line_docs()
    got = line_dedup.dedup_documents(spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "KEY")).collect()
    want = collections.Counter()
    for (doc, n, gone, text), times in lines_kept(rows).items():
        want[doc, n, gone, hashlib.sha256(text.encode()).hexdigest()] += times
    assert collections.Counter(tuple(r) for r in got) == want
    assert line_dedup.dedup_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS), most_broadcast=0).count() == 0


def test_line_filters_miss_no_repeat_and_suspect_few_others(spark):
    rng = np.random.default_rng(1)
    word = lambda i: f"{i:08d} " + "".join(map(chr, rng.integers(97, 122, 50)))
    unique, shared = [word(i) for i in range(20000)], [word(i) for i in range(20000, 20300)]
    rows = [(d, "\n".join(unique[d * 200 : d * 200 + 200] + [x for i, x in enumerate(shared) if d in (i % 100, (i * 7 + 1) % 100)]), "") for d in range(100)]
    held = collections.Counter(x for _, t, _ in rows for x in t.split("\n"))
    docs = spark.createDataFrame(rows, DOCS).repartition(6).selectExpr("0L AS _row", "doc_id", "text")
    filters = line_dedup.twice_seen(docs, segments=3, least_chars=40)
    found = {r.key for r in line_dedup.suspects(docs, filters, segments=3, least_chars=40, most_broadcast=1 << 20).collect()}
    repeats = {k for k, n in held.items() if n > 1}
    assert len(repeats) > 250
    assert repeats <= found
    assert len(found - repeats) < 0.03 * len(held)


# --- ranked search ---------------------------------------------------------------------------------------------------


def ranked(docs: list[tuple], items: list[tuple], k: int = 20) -> collections.Counter:
    terms = lambda t: re.findall(lexical_search._TERM, (t or "").translate(LOW))
    tf = [(d, collections.Counter(terms(t))) for d, t, *_ in docs]
    n, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(x for _, c in tf for x in c)
    w = lambda x: math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[x] + 1)))
    out = collections.Counter()
    for item, text in set(items):
        scored = []
        for d, c in tf:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            s = sum(times * w(x) * (1000000000 * c[x] // (1000 * c[x] + 12 * m)) for x, times in collections.Counter(terms(text)).items() if x in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if none else d, -s] += 1
    return out


def search_docs(n: int = 300) -> list[tuple]:
    rng = random.Random(5)
    v = [*vocabulary(rng, 120), "Ünï", "x1", "ok"]
    text = lambda k: " ".join(rng.choices(v, weights=[1 / (i + 1) for i in range(len(v))], k=k))
    rows = [(rng.randrange(10**6), text(rng.randint(1, 60)), "s") for _ in range(n)]
    return [*rows, (7, None, None), (8, "", "s"), (9, " .,!", "s"), (None, text(30), "s"), (None, text(30), "s"), rows[0], rows[0], (3, rows[1][1], "s"), (2, rows[1][1].upper(), "s"), (11, text(30000), "s")]


def items_of(docs: list[tuple]) -> list[tuple]:
    rng = random.Random(6)
    return [*[(i, " ".join(rng.choice(docs)[1].split()[:12]) if (i % 3) else docs[i][1]) for i in range(12)], (1, "ok ok ok x1"), (1, "ok ok ok x1"), (20, None), (21, "nowhere zzz"), (None, docs[4][1])]


@pytest.mark.parametrize(("block", "shard"), [(16 << 20, 16 << 20), (300, 1), (16 << 20, 4000)])
def test_search_is_brute_force(spark, block, shard):
    docs = search_docs()
    items = items_of([d for d in docs if d[1] and d[1].split()])
    got = lexical_search.ranked_search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block, shard_bytes=shard).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == ranked(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked_search(none, items).count() == 0
    assert lexical_search.ranked_search(spark.createDataFrame(search_docs(20), DOCS), items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_treaps_are_heaps_by_impact_and_search_trees_by_document(seed):
    rng = np.random.default_rng(seed)
    postings = np.unique(rng.integers(0, 5 * 400, 700))
    term, document, unit = postings // 400, postings % 400, rng.integers(1, [4, 1000][seed % 2], len(postings))
    t = lexical_search.Treaps(term, document, unit, 5, 400)
    seen, deepest = [], 0
    for k in range(5):
        stack = [(int(t.root[k]), 0, 400, 1 << 40, 1)]
        while stack:
            node, low, high, most, depth = stack.pop()
            if node == t.n:
                continue
            assert term[node] == k
            assert low <= t.document[node] < high
            assert t.unit[node] <= most
            deepest = max(deepest, depth)
            seen.append(node)
            stack += [(int(t.left[node]), low, int(t.document[node]), int(t.unit[node]), depth + 1), (int(t.right[node]), int(t.document[node]) + 1, high, int(t.unit[node]), depth + 1)]
    assert sorted(seen) == list(range(len(postings)))
    assert deepest < 40


def test_search_prunes(spark):
    """Where few documents hold the rare terms, most are never scored."""
    rng = np.random.default_rng(2)
    n = 4000
    rare = np.sort(rng.choice(n, 30, replace=False))
    term = np.concatenate([np.zeros(n, np.int64), np.ones(30, np.int64)])
    t = lexical_search.Treaps(term, np.concatenate([np.arange(n), rare]), np.concatenate([rng.integers(1, 100, n), rng.integers(800, 1000, 30)]), 2, n)
    best, scored = lexical_search.Best(20, 1), 0

    def offer(at, score):
        nonlocal scored
        scored += len(at)
        return best.offer(0, score, at)

    w = np.array([5, 1000])
    t.search(np.array([0, 1]), w, w, 1, offer)
    assert set(best.kept[0][1]) <= set(rare)
    assert scored < n / 4


# --- prefix trie -----------------------------------------------------------------------------------------------------


def conversations() -> list[tuple]:
    rng = random.Random(9)
    openings = [("system", "be kind"), ("user", "hello é"), (None, "hi"), ("user", None), ("user", "")]
    rows = []
    for c in [*range(0, 47), 101, 102, 500, -3, -7, 10**12 + 1]:
        if c % 11 == 10:
            continue
        n = rng.choice([0, 1, 2, 3, 5, 8, 12]) + 1
        turns = [openings[rng.randrange(2)]] + [rng.choice([*openings, ("assistant", f"r{rng.randrange(4)}")]) for _ in range(n - 1)]
        rows += [(c, i if i % 7 else (None if i else 0), r, t, "x") for i, (r, t) in enumerate(turns)]
    rows += [(600 + i, 0, "user", "one and the same", "x") for i in range(40)] + [(600 + i, 1, "user", "too", "x") for i in range(40)]
    rows += [(300, i // 2, "user", f"long {i % 50}", "x") for i in range(400)] + [(302, i, "user", f"long {i % 3}", "x") for i in range(300)]
    rows += [(700, None, "user", "again", "x")] * 60 + [(None, 1, "user", "nobody's", "x"), (12, 0, "user", "twice", "x"), (12, 0, "user", "twice", "x")]
    return rows


def trie(rows: list[tuple]) -> set:
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, below = collections.defaultdict(list), collections.defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                below[t[: d - 1]].add(t[:d])
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        saved[k] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] += k not in below
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if built[c] == k))).encode()).hexdigest()
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]) if k in below else 0, leaves[k], saved[k], ends(k)) for k, m in list(members.items())}


@pytest.mark.parametrize("pieces", [1, 13])
def test_trie_is_brute_force_whatever_the_pieces(spark, pieces):
    """13 pieces cut long conversations, repeated rows and families apart."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string, depth string")
        got = [tuple(r) for r in prefix_trie.prefix_trie(c).collect()]
        most = prefix_trie.turns(c).select("conv_id", "piece").distinct().groupBy("conv_id").count().agg({"count": "max"}).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (most > 2) == (pieces > 2)
    assert len(got) == len(set(got))
    assert set(got) == trie(conversations())


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
