"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from neurolith.llm import jaccard_join, line_cleaning, mixing, ngram_lm, packing, secrets, sharding, suffix_dedup, toxicity, vp_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 1, n: int = 60) -> list:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choices(vocabulary, k=k)) + "."
    out = [make(rng.randint(1, 120)) for _ in range(n)]
    base = make(150)
    for i in range(12):  # near copies
        w = base.split()
        w[rng.randrange(150)] = f"edit{i}"
        out.append(" ".join(w))
    shared = make(60)
    out += [make(30) + " " + shared + " " + make(30) for _ in range(6)]
    return [*out, out[0], out[0], None, "", "   \n\t", "one two", "one two", "ab" * 400, "x" * 500, make(9000), base]


def docs(spark, rows: list | None = None):
    rows = texts() if rows is None else rows
    data = [(i, t, ["en", "de", None][i % 3], "src0" if i % 3 else f"src{i % 7}", None if t is None else len(t)) for i, t in enumerate(rows)]
    return spark.createDataFrame([*data, data[3], (None, "a text without an id", None, None, 20)] if data else [], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def rows_of(table) -> list:
    return table.select("doc_id", "text").collect()


def words(t) -> list[str]:
    return WORD.findall(t or "")


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing_keeps_budgets_and_prefixes(spark, table, empty):
    got = mixing.mix_documents(table).collect()
    total = sum(len(words(r.text)) for r in rows_of(table))
    assert 0.97 * mixing.SHARE * total <= sum(r.take_tokens for r in got) <= mixing.SHARE * total + 1
    assert all(0 <= r.epoch < 4 and r.take_tokens <= r.n_tokens for r in got)
    assert mixing.mix_documents(empty).count() == 0
    assert set(mixing.keep_mixed(table).columns) == set(table.columns)


def test_mixing_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10.0), ("a", "x", "s2", 1000.0), ("b", "x", "s3", 1000.0)], "domain string, lang string, source string, avail double")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 600.0, {}, 1).collect()}
    assert got == {"s1": 10, "s2": 290, "s3": 300}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 2500.0, {}, 1).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 1000}


# --- sharding --------------------------------------------------------------------------------------------------------


def test_sharding_balances_bytes_and_slots(table, empty):
    got = sharding.shard_documents(table).collect()
    assert len(got) == table.count()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(size) <= set(range(8))
    most = max(r.size for r in got)
    assert max(size.values()) - min(size.values() if len(size) == 8 else [0]) <= 2 * most  # the law: sizes near equal
    by_id = {r.doc_id: r for r in got}
    for r in rows_of(table):
        body = (r.text or "").encode()
        assert by_id[r.doc_id].size == len(body) + 1
        assert by_id[r.doc_id].text_crc32 == zlib.crc32(body)
    assert sharding.shard_documents(empty).count() == 0


# --- language model --------------------------------------------------------------------------------------------------


def test_lm_base_is_exact_and_paths_agree(spark, table, empty):
    got = ngram_lm.score_documents(table).collect()
    rows = rows_of(table)
    assert len(got) == len(rows)
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["</s>"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in low(r.text))
    n, v = sum(c.values()), len(c)
    want = {r.doc_id: r.text for r in rows}
    for r in got:
        t = low(want[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score <= 0
    train = ngram_lm.F.pmod(ngram_lm.F.crc32(ngram_lm.F.coalesce(ngram_lm.F.col("doc_id").cast("string"), ngram_lm.F.lit("")).cast("binary")), ngram_lm.F.lit(7)) != 2
    joined = {(r.doc_id, r.n_tokens): r for r in ngram_lm.score(table, train=train, most_broadcast=-1).collect()}
    for r in got:
        j = joined[r.doc_id, r.n_tokens]
        assert math.isclose(j.base_score, r.base_score, rel_tol=1e-9) and abs(j.score - r.score) < 0.05 * abs(r.score) + 0.01
        assert j.n_known == r.n_known
    assert ngram_lm.score_documents(empty).count() == 0


def test_lm_filter_never_loses_a_level():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    level = rng.integers(0, 9, len(h))
    segment = ngram_lm.segment_of(h, 4)
    f = ngram_lm.LogFilter([ngram_lm.make_segment(h[segment == s], level[segment == s], (10, 4), 2.0) for s in range(4)], (10, 4))
    got = f.levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.95
    assert (f.levels(rng.integers(0, 2**63, 20000).astype(np.uint64)) > 0).mean() < 0.005


def test_lm_keeps_pairs_seen_once(spark):
    assert ngram_lm.level_of(np.array([0, 1, 2, 3, 4, 5])).tolist() == [0, 1, 2, 3, 3, 4]
    d = spark.createDataFrame([(0, "a b"), (1, "c d"), (2, "a b"), (3, "a d")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(d, train=ngram_lm.F.col("doc_id") < 2).collect()}
    assert got[2].held_out and math.isclose(got[2].base_score, got[3].base_score)
    assert got[2].score > got[3].score  # each of the four words was seen once, and so was the pair (a, b)


def test_lm_scores_do_not_depend_on_size(spark, table, empty):
    kw = {"train": ngram_lm.F.coalesce(ngram_lm.F.col("doc_id") % 3 != 0, ngram_lm.F.lit(True)), "probes": (2, 1)}  # many false members
    runs = [sorted((repr(tuple(r)[:5]), r.base_score, r.score) for r in ngram_lm.score(table, most_broadcast=m, **kw).collect()) for m in (400 << 20, -1)]
    assert len(runs[0]) == len(runs[1]) == table.count()
    for a, b in zip(*runs, strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) and math.isclose(a[2], b[2], rel_tol=1e-9)
    assert ngram_lm.score(empty, most_broadcast=-1, **kw).count() == 0


def test_lm_large_model_shuffles_little(spark):
    """Where the model is too large to send, what is shuffled and written on the way stays within a few bytes for each of the texts'."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=1000))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved(first: int) -> tuple[int, int]:
        stages, i, missing = [], first, 0
        while missing < 50:  # stages that are skipped have no attempt
            try:
                stages.append(store.lastStageAttempt(i))
                missing = 0
            except Exception:
                missing += 1
            i += 1
        return i - missing, sum(x.shuffleWriteBytes() + x.outputBytes() for x in stages)

    first, _ = moved(0)
    kw = {"train": ngram_lm.F.col("doc_id") % 7 != 2, "segment_tokens": 100_000}
    assert ngram_lm.score(d, most_broadcast=-1, **kw).count() == len(rows)
    _, n_bytes = moved(first)
    assert 0 < n_bytes < 6 * sum(len(t) for _, t in rows)


def test_lm_hashes_survive_packing():
    h = np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (ngram_lm.unpack(1, ngram_lm.pack(1, h)) == h).all()
    packed = ngram_lm.pack(2, h)
    assert len(packed) == 5 * len(h) and (ngram_lm.unpack(2, packed) == h & ngram_lm.PAIR).all()
    assert not len(ngram_lm.unpack(2, ngram_lm.pack(2, h[:0])))
    assert (ngram_lm.bits_of(h, 3, 1, 1000) == ngram_lm.bits_of(h & ngram_lm.PAIR, 3, 1, 1000)).all()


def test_lm_long_repeated_and_empty_texts_where_the_model_is_routed(spark):
    rows = [(1, "a b c " * 300_000), (2, "a b"), (2, "a b"), (None, None), (None, None), (3, ""), (4, "b a"), (5, "c " * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for train in (ngram_lm.F.coalesce(ngram_lm.F.col("doc_id") != 4, ngram_lm.F.lit(True)), ngram_lm.F.lit(False)):
        runs = [sorted(map(repr, ngram_lm.score(d, train=train, most_broadcast=m).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", ngram_lm.F.round("base_score", 6), ngram_lm.F.round("score", 6)).collect())) for m in (400 << 20, -1)]
        assert runs[0] == runs[1] and len(runs[0]) == len(rows)


# --- line cleaning ---------------------------------------------------------------------------------------------------


def test_quality_counts(table, empty):
    got = {r.doc_id: r for r in line_cleaning.quality_rules(table).collect()}
    for r in rows_of(table):
        t, w, q = r.text or "", words(r.text), got[r.doc_id]
        lines = [x for x in t.split("\n") if words(x)]
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert q.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (q.base_failed and q.kept)
    assert line_cleaning.quality_rules(empty).count() == 0


def test_cleaning_removes_lines(spark):
    d = spark.createDataFrame([(1, "This is a line of prose.\nHome | About | Contact\nAll rights reserved.\nAnd this is one more line."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_cleaning.clean_lines(d).collect()}
    assert got[1].clean_text == "This is a line of prose.\nAnd this is one more line." and got[1].n_failed_lines == 2
    assert got[2].clean_text is None and got[2].lost == 0


# --- secrets ---------------------------------------------------------------------------------------------------------


def secret_rows() -> list:
    key, hexa = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef" * 2
    return ["password = hunter22 and token: abc", f"é {key} x {hexa}", "PassWD='S3cr3t/+x' api-key=1234567", None, "", "no secrets here " * 3000 + "secret: longenough", f"{hexa}{hexa}", "AKIA" + "A" * 15, "see https://host.example.com/a user=alice password=hunter2222", "see https://host.example.com/a"]


def test_secret_spans_match_python(spark):
    rows = secret_rows()
    got = {r.doc_id: r for r in secrets.scan_documents(docs(spark, rows)).collect()}
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(rows):
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        order = {"assign": 0, "access": 1, "hex": 2}
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda x: (x[1], order[x[0]])))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t[:60], got[i].spans, line)
        assert set(line.split(",")) <= {*got[i].spans.split(","), ""}
    assert "linked_endpoint" in got[8].spans and got[9].spans == ""


def plain_spans(t: str, scope: int = 200) -> list[tuple]:
    """Every base span and every completed weak part by looking at all pairs."""
    found = []
    for k, (_, pattern, role, least, _) in enumerate(secrets.KINDS):
        found += [(m.start(), k, m.end(), role) for m in re.finditer(pattern, t) if not least or len(m[2]) >= least]
    strong = [x for x in found if x[1] < secrets.STRONG]
    weak = [x for x in found if x[1] >= secrets.STRONG and not any(s[0] < x[2] and x[0] < s[2] for s in strong)]
    near = lambda x: any((x[3] == "secret") != (y[3] == "secret") and y[2] > x[0] - scope and y[0] < x[2] + scope for y in strong + weak)
    return sorted(x[:3] for x in strong + [x for x in weak if near(x)])


def secret_soup(seed: int, n: int) -> str:
    rng = random.Random(seed)
    part = lambda: rng.choice(["password=hunter%05d", "https://h%d.example.com/a", "user=alice%d", "AKIAABCDEFGH1234%04d", "deadbeef" * 4 + "%d", "Zx9Zx9Zx9Zx9Zx9Zx9Zx%d", "token: https://x%d.example.com/yyyy", "login = bob%d"]) % rng.randrange(10000)
    return "".join(part() + rng.choice([" ", " ", "\n", " é" * rng.randint(0, 250)]) for _ in range(n))


def test_linked_spans_match_all_pairs(spark):
    rows = [secret_soup(seed, n) for seed, n in enumerate([1, 2, 2, 3, 3, 5, 8, 30, 200])]
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.secrets) for r in secrets.secret_spans(docs(spark, rows)).filter("doc_id IS NOT NULL").collect()}
    for i, t in enumerate(rows):
        assert got[i] == plain_spans(t), i
    assert secrets.secret_spans(docs(spark, [])).count() == 0


def test_many_parts_in_one_text(spark):
    t = secret_soup(99, 20_000)
    began = time.time()
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = secrets.redact(secrets.secret_spans(d)).first()
    assert time.time() - began < 60
    want, at, out = plain_spans_of_many(t), 0, []
    assert [(s.start, s.kind, s.end) for s in got.secrets] == want
    end = -1
    for a, _, b in want:
        if a > end:
            out += [t[at:a], "[SECRET]"]
        at = end = max(end, b)
    assert got.text == "".join(out) + t[at:]


def plain_spans_of_many(t: str, step: int = 4000, margin: int = 2000) -> list[tuple]:
    """plain_spans by overlapping pieces, whose edges are cut at spaces far from what is taken from them."""
    out, lo = set(), 0
    while lo < len(t):
        a, b = t.rfind(" ", 0, max(0, lo - margin)) + 1, t.find(" ", min(len(t), lo + step + margin))
        out |= {(x + a, k, y + a) for x, k, y in plain_spans(t[a : len(t) if b < 0 else b]) if lo <= x + a < lo + step}
        lo += step
    return sorted(out)


def test_redaction(spark):
    got = {r.doc_id: r.text for r in secrets.redact(secrets.secret_spans(docs(spark, secret_rows()))).collect()}
    assert got[0] == "[SECRET] and token: abc" and got[3] is None and got[4] == ""
    assert not any("hunter" in (t or "") for t in got.values())


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_covers_all_and_fits(table, empty):
    got = packing.pack_documents(table).collect()
    assert sum(r.n_tokens for r in got) == sum(len(words(r.text)) for r in rows_of(table))
    bins = collections.defaultdict(list)
    for r in got:
        assert (r.bin is None) == (r.n_tokens == 0)
        if r.bin:
            bins[r.bin].append(r)
    for v in bins.values():
        at = 0
        for r in sorted(v, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.n_tokens
        smaller = [c for c in packing.CAPACITIES if c < v[0].capacity]
        assert at <= v[0].capacity and all(c < at for c in smaller)
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(4)
    seen = set()
    for case in range(6):
        lengths = np.sort(rng.integers(1, [4097, 300, 1100, 2049, 4097, 700][case], 300))[::-1]
        bins, starts, sizes = packing.pack_lengths(lengths, packing.CAPACITIES, packing.CHARGE, packing.ATTENTION)
        waiting, room, opened = lengths.tolist(), [], []
        for n, b in zip(lengths.tolist(), bins.tolist(), strict=True):
            waiting.pop(0)
            fits = [r for r in room if r >= n]
            if fits:
                assert room[b] == min(fits)
            else:
                cost = {}
                for c in packing.CAPACITIES:
                    if c >= n:
                        left = c - n
                        for x in waiting:  # longest first: takes what fits
                            left -= x if x <= left else 0
                        cost[c] = (c + packing.CHARGE + packing.ATTENTION * c * c) / (c - left)
                assert b == len(room)
                opened.append(max(c for c in cost if cost[c] == min(cost.values())))
                room.append(opened[-1])
            room[b] -= n
        used = np.bincount(bins, lengths)
        assert (used <= sizes).all() and set(sizes) <= set(packing.CAPACITIES)
        seen |= set(opened)
        price = lambda c: (c + packing.CHARGE + packing.ATTENTION * c * c).sum()
        one, _, shrunk = packing.pack_lengths(lengths, (4096,), packing.CHARGE, packing.ATTENTION)
        fixed = np.array(packing.CAPACITIES)[np.searchsorted(packing.CAPACITIES, np.bincount(one, lengths))]
        assert price(sizes.astype(float)) <= price(fixed.astype(float))  # no dearer than one size, shrunk at the end
    assert seen == set(packing.CAPACITIES)


def test_packing_is_the_same_in_any_layout(spark, table):
    extra = table.unionByName(table.filter("doc_id < 20"))
    a, b = (sorted(map(repr, packing.pack_documents(d).collect())) for d in (extra, extra.repartition(7, "n_chars")))
    assert a == b and len(a) == len(packing.pack_documents(table).collect()) + packing.pack_documents(table.filter("doc_id < 20")).count()


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_gradient_is_right():
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network().items()}
    units = toxicity.Units(*toxicity.arrow_bytes(toxicity.pa.array(["you awful thing " + "z" * 60, "kind words"], toxicity.pa.large_string())))
    _, first, size = units.windows()
    at = lambda n: toxicity.gradient(n, units, first, size, np.array([1, 0]), np.ones(2))
    grad, _ = at(net)
    for k in net:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        loss = []
        for e in (1e-2, -1e-2):
            moved = net[k].copy()
            moved[i] += e
            loss.append(at(net | {k: moved})[1])
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k][i]) < 2e-3 + 0.03 * abs(grad[k][i]), k


def test_windows_cover_every_unit():
    units = toxicity.Units(*toxicity.arrow_bytes(toxicity.pa.array(["a " * 200, "", None, "w" * 100, "b"], toxicity.pa.large_string())))
    text, first, size = units.windows()
    seen = {(t, u) for t, f, s in zip(text, first, size, strict=True) for u in range(f, f + s)}
    assert {u for t, u in seen} == set(range(units.text_start[-1])) and set(text) == {0, 3, 4}


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(200)]
    rows, marks = [], []
    for i in range(700):
        w = rng.choices(vocabulary, k=rng.randint(20, 150))
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zonk", "quix"])
        rows.append(" ".join(w))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.rate_documents(docs(spark, [*rows, None, ""]), labels).collect()
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.doc_id in (700, 701))
    assert toxicity.rate_documents(empty, labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs(spark), labels.limit(0)).count() == docs(spark).count()


# --- near duplicates -------------------------------------------------------------------------------------------------


def shingle_set(t) -> frozenset:
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("how", [{}, {"block": 4}, {"block": 4, "whole_up_to": 0.0, "rows_per_run": 200}])
def test_jaccard_join_is_whole(table, empty, how):
    got = jaccard_join.jaccard_join(table, **how).collect()
    rows = rows_of(table)
    assert len(got) == len(rows)
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r.text or ""].append(r.doc_id)
    different = list(ids)
    sets = [shingle_set(t) for t in different]
    up, links = list(range(len(different))), collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = lambda v: min((i for i in v if i is not None), default=None)
    groups = collections.defaultdict(list)
    for i, t in enumerate(different):
        groups[root(i)] += ids[t]
    of_id = {j: i for i, t in enumerate(different) for j in ids[t]}
    for r in got:
        i = of_id[r.doc_id]
        assert (r.class_id, r.copy_id, r.n_links) == (least(groups[root(i)]), least(ids[different[i]]), links[i])
    assert max(links.values()) >= 10
    assert jaccard_join.join_documents(empty).count() == 0


def test_forest_recall_and_depths():
    """At several similarities, pairs of sets meet in some tree as often as worked out, and at the threshold as often as asked."""
    rng = np.random.default_rng(8)
    trees, deepest, pairs = 24, 7, 1500
    for similarity in (0.8, 0.85, 0.9):
        both, each = int(200 * similarity), (200 - int(200 * similarity)) // 2
        h = rng.integers(0, 2**63, (pairs, 200), dtype=np.uint64)
        a, b = h[:, : both + each], np.concatenate([h[:, :both], h[:, both + each :]], axis=1)
        sign = [jaccard_join.signatures(x.ravel(), np.arange(0, x.size + 1, x.shape[1]), trees, deepest) for x in (a, b)]
        for depth in (5, 7):
            met = (sign[0][:, :, :depth] == sign[1][:, :, :depth]).all(axis=2).any(axis=1).mean()
            assert abs(met - (1 - (1 - (both / (both + 2 * each)) ** depth) ** trees)) < 0.02
            assert depth == 7 or met > 0.998
    stops = jaccard_join.depths(0.8, trees, deepest, 0.9998)
    assert stops[1] == stops[3] == deepest and stops[4] == stops[-1] == 5 and (stops >= 5).all() and stops[7] > 5


def test_trie_runs_in_any_cut(spark):
    """Nodes of a sorted forest are whole wherever it is cut into runs."""
    rng = np.random.default_rng(9)
    path = rng.integers(0, 3, (300, 4)).astype(np.uint16)
    tree, own = rng.integers(0, 3, 300), rng.choice([2, 3, 4], 300)
    order = np.lexsort((*path.T[::-1], tree))
    path, tree, own = path[order], tree[order], own[order]
    found = collections.defaultdict(set)
    cuts = [0, *sorted(rng.choice(300, 7, replace=False).tolist()), 300]
    for lo, hi in zip(cuts, cuts[1:]):
        for k, at in jaccard_join.met_in_trie(tree[lo:hi], path[lo:hi], own[lo:hi]) if hi > lo else []:
            for i in at:
                found[int(tree[lo + i]), k, tuple(path[lo + i, :k].tolist())].add(lo + int(i))
    met = {(a, b) for v in found.values() for a in v for b in v if a < b}
    for a in range(300):
        for b in range(a + 1, 300):
            k = min(own[a], own[b])
            if tree[a] == tree[b] and (path[a, :k] == path[b, :k]).all():
                assert (a, b) in met


def test_keep_first_leaves_one_of_each(table):
    left = jaccard_join.keep_first(table)
    ids = [r.doc_id for r in left.collect()]
    want = {r.class_id for r in jaccard_join.join_documents(table).collect()}
    assert sorted(map(str, ids)) == sorted(map(str, want)) and left.columns == table.columns


# --- suffix dedup ----------------------------------------------------------------------------------------------------


def repeated(bodies: list[bytes], length: int) -> list[tuple]:
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffix_dedup_matches_brute_force(table, empty, hot, monkeypatch):
    if hot == 1:
        plain = suffix_dedup.repeated_spans
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, **k: plain(d, contexts_per_key=1, most_broadcast=-1, **k))
    got = suffix_dedup.dedup_documents(table).collect()
    bodies = [(r.text or "").encode() for r in rows_of(table)]
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(repeated(bodies, 200))
    assert suffix_dedup.dedup_documents(empty).count() == 0


@pytest.mark.parametrize("most", [5000, 3, 1])
def test_suffix_dedup_hot_keys(spark, monkeypatch, most):
    """Passages shorter, as long as, and longer than a window, each in many surroundings: their keys are hot at every level."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [noise(n) for n in (40, 150, 199, 200, 201, 330)]
    texts = [noise(rng.randint(0, 260)) + c + rng.choice("xyz") + noise(rng.randint(0, 260)) for c in common for _ in range(9)]
    texts += ["q" * n for n in (199, 200, 201, 700)] + ["\u00e9" * 150 + noise(60)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    used = []
    plain = suffix_dedup.spans_by_anchor
    monkeypatch.setattr(suffix_dedup, "spans_by_anchor", lambda d, grams, **k: used.append(grams) or plain(d, grams, **{**k, "contexts_per_key": most}))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_documents(docs).collect()}
    assert got == dict(enumerate(repeated([t.encode() for t in texts], 200)))
    assert used == [(32, 116, 199), (116, 199), (199,)][: 1 if most == 5000 else 3]


def test_suffix_array_order():
    rng = random.Random(3)
    for _ in range(200):
        t = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(1, 50))] + [0], np.uint8)
        key = lambda i, b=t.tobytes(): (b[i:] + bytes(60))[:60]
        got = suffix_dedup.suffix_array(t, 60).tolist()
        assert sorted(got) == list(range(len(t))) and [key(i) for i in got] == sorted(map(key, range(len(t))))


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def test_vp_search_is_exact(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[100:180] = v[100]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [None] + [1.0] * 7), (1200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (1250, [])]
    d = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    got = vp_search.vp_search(d, d.filter("vec_id % 50 = 0"), rows_per_shard=90, queries_per_block=3, leaf=8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == {i for i in range(400) if i % 50 == 0}
    w = v.astype(np.float64)
    for q, found in by.items():
        score = vp_search.cosine(np.repeat(w[q : q + 1], 400, axis=0), w)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [x[1] for x in sorted(found)] == want and [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]
    assert vp_search.search_embeddings(d.limit(0)).count() == 0


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (1.1, 0.97), (1.3, 0.9)])
def test_vp_recall_by_factor(factor, least):
    rng = np.random.default_rng(6)
    p = vp_search.unit(np.repeat(rng.normal(size=(60, 16)), 50, axis=0) + rng.normal(size=(3000, 16)) * 0.3)
    tree, ids = vp_search.build_tree(p, 16), np.arange(3000)
    q, at = vp_search.search_tree(tree, p, ids, p[::10], ids[::10], 5, factor)
    cos = p[::10] @ p.T
    cos[np.arange(300), ids[::10]] = -2
    best = np.argsort(-cos, axis=1)[:, :5]
    found = set(zip(q.tolist(), at.tolist()))
    recall = np.mean([(i, int(j)) in found for i, row in enumerate(best) for j in row])
    assert recall >= least


def test_vp_takes_any_size_of_numbers(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [3e-200, 3e-200]), (3, [-1.0, -1.0]), (4, [5e-324, 5e-324]), (5, [1.7e308, 1.7e308])]
    d = spark.createDataFrame([*rows, (0, [1e200, 1e200]), (2, [3e-200, 3e-200])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r["rank"], round(r.score, 9)) for r in vp_search.search_embeddings(d).orderBy("rank").collect()]
    assert got == [(2, 1, 1.0), (4, 2, 1.0), (5, 3, 1.0), (1, 4, round(3 / math.sqrt(10), 9)), (3, 5, -1.0)]


def test_vp_lengths_and_hot_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [1.0] * (1 + i % 40)) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vp_search.vp_search(d, d.filter("vec_id % 50 = 0"), rows_per_shard=40, queries_per_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, found in got.items():
        v = rows[q][1]
        score = lambda i, v=v: sum(a * b for a, b in zip(v, rows[i][1])) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in rows[i][1]))
        want = sorted((i for i in range(500) if i != q and len(rows[i][1]) == len(v)), key=lambda i: (-round(score(i), 12), i))[:5]
        assert found == want


# --- names and pipeline ----------------------------------------------------------------------------------------------

CLASHES = ("_id", "_key", "_t", "_k", "_s", "_n", "_row", "_times", "_copy", "_lines", "_good", "_spans", "secrets", "toxic_score", "text_key", "label", "range", "shard", "other0", "Doc_id", "TEXT")


def test_clashing_columns_pass_through(spark, empty):
    import corpus_pipeline

    for d in (docs(spark).limit(40), empty):
        n = len(d.columns)
        d = d.select("*", *[d.text.alias(x) for x in CLASHES])
        d = d.toDF(*d.columns)
        rows = d.collect()
        labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
        kept = {"toxicity": toxicity.drop_toxic(d, labels)}
        kept |= {name: stage(spark, d, "") for name, stage in corpus_pipeline.STAGES[1:4]}
        for name, got in kept.items():
            assert got.columns == d.columns, name
            out = got.collect()
            assert not rows or out, name
            for r in out:  # a clashing column holds the row's first text still
                assert name == "secrets" or all(r[i] == r[1] for i in range(n, n + len(CLASHES))), name
        assert len(kept["secrets"].collect()) == len(kept["toxicity"].collect()) == len(rows)
        assert line_cleaning.clean_lines(d).columns == [*d.columns, "clean_text", "n_lines", "n_failed_lines", "lost", "line_kept"]
        assert secrets.secret_spans(d).columns == [*[c for c in d.columns if c != "secrets"], "secrets"]
        small = [ngram_lm.score_documents, packing.pack_documents, jaccard_join.join_documents, suffix_dedup.dedup_documents, sharding.shard_documents, line_cleaning.quality_rules, mixing.mix_documents, secrets.scan_documents, lambda x: toxicity.rate_documents(x, labels)]
        for f in small:
            assert f(d).count() >= (len(rows) > 0)


def test_string_ids_and_repeated_labels(spark):
    rng = random.Random(5)
    rows = [(f"id{i % 50}", " ".join(rng.choices("abcdefgh", k=30)) + (" zonk" if i % 2 else ""), "en", "src0", 60) for i in range(100)]
    d = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string"))
    labels = spark.createDataFrame([(f"id{i}", i % 2) for i in range(50)] * 2, "doc_id string, toxic int")
    assert toxicity.rate_documents(d, labels).count() == 100
    assert packing.pack_documents(d).count() == 100 and mixing.keep_mixed(d).count() > 0
    assert jaccard_join.keep_first(d).count() <= 100


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage after the first by its rows, over all that the stage before it kept."""
    import corpus_pipeline
    import duckdb

    key = "AKIA" + "ABCDEFGH12345678"
    given = docs(spark, texts()[:-2] + [f"the key is {key} and more", None, "password = hunter2222"])
    given.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: corpus_pipeline.cut(stages[name](spark, d, str(tmp_path)))
    multiset = lambda d: collections.Counter(map(repr, d.collect()))
    d0 = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d1 = step("toxicity", d0)
    left = multiset(d1)
    assert not left - multiset(d0) and len(left) > 20
    scores = toxicity.rate(d0, toxicity.fit(d0, spark.read.parquet(f"{tmp_path}/labels.parquet")), keep=d0.columns).filter("toxic_score < 0.5").drop("toxic_score")
    assert multiset(scores) == left

    d2 = step("near_duplicates", d1)
    rows = d1.collect()
    sets, group = [shingle_set(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a].text or "") == (rows[b].text or "")
            if same or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group, strict=True):
        if g not in first or (r.doc_id is not None and (first[g].doc_id is None or r.doc_id < first[g].doc_id)):
            first[g] = r
    assert multiset(d2) == collections.Counter(repr(r) for r in first.values())

    d3 = step("secrets", d2)
    want = collections.Counter()
    for r in d2.collect():
        t, out, at = r.text, "", 0
        for a, _, b in plain_spans(t or ""):
            if a > at or not out:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        t = t if t is None else out + t[at:]
        want[repr(r.asDict() | {"text": t, "n_chars": None if t is None else len(t)})] += 1
    assert collections.Counter(repr(r.asDict()) for r in d3.collect()) == want

    d4 = step("mixing", d3)
    d3.coalesce(1).write.parquet(f"{tmp_path}/d3")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d3/*.parquet'")
    times = collections.Counter(i for (i,) in con.execute(f"SELECT doc_id FROM ({mixing.oracle()})").fetchall())
    want = collections.Counter()
    for r in d3.collect():
        if times[r.doc_id]:
            want[repr(r)] += times[r.doc_id]
    assert multiset(d4) == want

    d5 = step("packing", d4)
    packed = collections.Counter()
    for r in d5.collect():
        packed[r.doc_id] += r.n_tokens
    tokens = collections.Counter()
    for r in d4.collect():
        tokens[r.doc_id] += len(words(r.text))
    assert packed == tokens
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert multiset(out) == multiset(d5)
