"""Mixing sources to target weights: budgets flow down a domain-language-source tree, texts fill them epoch by epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolith.llm.common import cut, n_words, sheltered

LEVELS = ("domain", "lang", "source")


def _share(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Add `budget`: what each node gets of its parent's budget, in proportion to w, none above its cap.

    Water filling in closed form: with siblings by cap / w, a node is full if the budget reaches its level while all
    before it are full; the rest share what is left by weight. A shortage thus goes to siblings first, and to the parent's
    siblings only if the whole family is full, since a parent never gets more than its family's caps.
    """
    level = F.when(F.col("w") > 0, F.col("cap") / F.col("w"))
    by = Window.partitionBy(*parent).orderBy(F.col("_level").asc_nulls_last(), *[c for c in LEVELS if c in nodes.columns])
    family = Window.partitionBy(*parent)
    n = nodes.withColumn("_level", level).withColumn("_in", budget)
    n = n.withColumn("_w_left", F.sum("w").over(family) - F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    n = n.withColumn("_c_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    n = n.withColumn("_full", F.coalesce(F.col("_level") * F.col("_w_left") + F.col("_c_before") <= F.col("_in"), F.lit(False)))
    full_cap = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(F.lit(0.0))).over(family)
    open_w = F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("w"))).over(family)
    part = F.when(F.col("_full"), F.col("cap")).when(open_w > 0, F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("_in") - full_cap) * F.col("w") / open_w)).otherwise(F.lit(0.0))
    return n.withColumn("budget", part).drop("_level", "_in", "_w_left", "_c_before", "_full")


def leaf_budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, avail tokens) -> budget tokens of each leaf.

    weights: for each level a weight by node name; a name without one weighs 1, and a weight of 0 gives a node nothing. No
    leaf gets more than max_epochs times its tokens. total: the tokens of the whole mix.
    """

    def w(level: str) -> Column:
        out = F.lit(1.0)
        for name, x in weights.get(level, {}).items():
            out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(out)
        return out

    caps = leaves.withColumn("cap", F.col("avail") * F.lit(float(max_epochs)))
    for level in reversed(LEVELS):
        caps = caps.withColumn("cap", F.when(w(level) > 0, F.col("cap")).otherwise(F.lit(0.0)))
    tops = caps.groupBy("domain").agg(F.sum("cap").alias("cap"))
    tops = _share(tops.withColumn("w", w("domain")), [], F.least(F.lit(total), F.sum("cap").over(Window.partitionBy())))
    mids = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", w("lang"))
    null_safe = lambda a, b, keys: a.join(b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("budget").alias("_budget")), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    mids = _share(null_safe(mids, tops, ["domain"]), ["domain"], F.col("_budget")).drop("_budget")
    low = _share(null_safe(caps.withColumn("w", w("source")), mids, ["domain", "lang"]), ["domain", "lang"], F.col("_budget")).drop("_budget")
    return low.select(*LEVELS, "avail", F.floor(F.col("budget") + F.lit(1e-6)).cast("long").alias("budget"))


def mix(docs: DataFrame, *, domain: Column, tokens: Column, total: float | None = None, share: float = 1.0, weights: dict[str, dict[str, float]] | None = None, max_epochs: int = 4, seed: str = "mix-1", rows_per_bucket: int = 100_000) -> DataFrame:
    """Select each leaf's prefix of its token stream: one row (doc_id, domain, lang, source, epoch, n_tokens, take_tokens)
    per document and epoch that it enters.

    docs needs doc_id, lang and source. total is the budget in tokens, or else share of all tokens. A leaf's stream is epoch
    0, 1, ... of its documents, each epoch in the order of md5(seed, epoch, doc_id); a document is in if its first token
    lies within the leaf's budget, and take_tokens says how many of its tokens the budget covers (fewer than n_tokens only
    for the last). Full epochs need no order, so each document is ordered once, for its leaf's last, partial epoch. The
    order's running sums come in two steps (sums by the leading bits of the hash, then a window within each of those
    buckets), so a leaf with a third of all rows is spread over many tasks. Texts are read once, to count tokens; the
    rest works on ids and counts; the number of buckets grows with the rows, so that one holds about rows_per_bucket at most.

    Nulls in lang or source are a node of their own; documents without tokens are in if their place lies before the
    budget's end (never in a leaf without budget); repeated rows each count; an empty table gives an empty result; other
    columns of docs, whatever their names, are not looked at.
    """
    d = cut(docs.select("doc_id", domain.alias("domain"), "lang", "source", tokens.cast("long").alias("n_tokens")))
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("double").alias("avail"))
    rows, all_tokens = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    buckets = min(1 << 24, max(64, -(-rows // rows_per_bucket)))
    if total is None:
        total = share * all_tokens
    plan = leaf_budgets(leaves, float(total), weights or {}, max_epochs).filter("budget > 0")
    full = F.floor(F.col("budget") / F.col("avail")).cast("int")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], full.alias("full"), (F.col("budget") - full * F.col("avail")).cast("long").alias("left"))
    leaf = [f"_{c}" for c in LEVELS]
    e = d.join(plan, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS])
    e = e.withColumn("_order", F.md5(F.concat_ws("-", F.lit(seed), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    e = e.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int"))
    sums = e.filter("left > 0").groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_b"))
    before = sums.select(*[F.col(c).alias(f"_b{c}") for c in leaf], F.col("_bucket").alias("_b_bucket"), (F.sum("_b").over(Window.partitionBy(*leaf).orderBy("_bucket")) - F.col("_b")).alias("_before"))
    e = e.join(before, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in leaf] + [F.col("_bucket") == F.col("_b_bucket")], "left")
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf, "_bucket").orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_from", F.coalesce("_before", F.lit(0)) + running - F.col("n_tokens"))
    partial = (F.col("left") > 0) & (F.col("_from") < F.col("left"))
    none = F.array().cast("array<int>")
    epochs = F.concat(F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(none), F.when(partial, F.array("full")).otherwise(none))
    e = e.withColumn("epoch", F.explode(epochs))
    take = F.when(F.col("epoch") < F.col("full"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), F.col("left") - F.col("_from")))
    return e.select("doc_id", *LEVELS, "epoch", "n_tokens", take.cast("long").alias("take_tokens"))


#: The production mix. documents has no domain: sources are dealt to four by their number.
DOMAINS = ("web", "books", "code", "talk")
WEIGHTS = {"domain": {"web": 4.0, "books": 3.0, "code": 2.0, "talk": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 0.5}}
SHARE = 0.8


def domain_of(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1), F.lit("")).try_cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in DOMAINS]), F.pmod(number, F.lit(len(DOMAINS)))), F.lit("other"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The production mix of documents; tokens are words. Nulls, repeats and empty tables: as in mix, whatever the columns' names."""
    docs, _ = sheltered(docs, "doc_id", "text", "lang", "source")
    return mix(docs, domain=domain_of(F.col("source")), tokens=n_words(F.col("text")), share=SHARE, weights=WEIGHTS)


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the production mix selects, once per epoch; columns as they are, whatever their names.

    Rows that share a doc_id (null too) share its fate. Nulls, documents without tokens and empty tables: as in mix.
    """
    d, back = sheltered(docs, "doc_id", "text", "lang", "source")
    chosen = mix_documents(d).groupBy(F.col("doc_id").alias("_id")).agg((F.max("epoch") + 1).alias("_times"))
    # Epochs are selected in order, so the highest one counts them.
    return back(d.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))


def oracle() -> str:
    """DuckDB's version of mix_documents."""
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1.0 END"
    domain = "CASE try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DOMAINS)) + " ELSE 'other' END"

    def share(name: str, nodes: str, parent: str, order: str, budget: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}_1 AS (SELECT *, {budget} AS b_in, sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
  coalesce(sum(cap) OVER ({over} ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before FROM {nodes}),
{name}_2 AS (SELECT *, cap / w * w_left + c_before <= b_in AS is_full FROM {name}_1),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, greatest(0, b_in - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({over})) * w / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({over}), 0)) END AS budget FROM {name}_2)"""

    return f"""
WITH d AS (SELECT doc_id, {domain} AS domain, lang, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS avail, 4.0::DOUBLE * sum(n_tokens) AS cap, {case("source")}::DOUBLE AS w FROM d GROUP BY ALL),
t AS (SELECT {SHARE}::DOUBLE * sum(avail) AS total, sum(cap) AS cap FROM l),
a0 AS (SELECT domain, sum(cap) AS cap, {case("domain")}::DOUBLE AS w FROM l GROUP BY domain),
{share("a", "a0", "", "domain", "(SELECT least(total, cap) FROM t)")},
m0 AS (SELECT x.domain, x.lang, sum(x.cap) AS cap, {case("lang")}::DOUBLE AS w, any_value(a.budget) AS pb FROM l x JOIN a ON x.domain IS NOT DISTINCT FROM a.domain GROUP BY x.domain, x.lang),
{share("m", "m0", "domain", "lang", "pb")},
s0 AS (SELECT l.*, m.budget AS pb FROM l JOIN m ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang),
{share("s", "s0", "domain, lang", "source", "pb")},
p AS (SELECT domain, lang, source, avail, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM s WHERE floor(budget + 1e-6) > 0),
q AS (SELECT *, CAST(floor(budget / avail) AS INT) AS n_full, CAST(budget - floor(budget / avail) * avail AS BIGINT) AS remains FROM p),
e AS (SELECT d.*, n_full, remains, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('mix-1-' || n_full || '-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start
      FROM d JOIN q ON d.domain = q.domain AND d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, unnest(range(0, n_full + CASE WHEN remains > 0 AND start < remains THEN 1 ELSE 0 END)) AS ep FROM e)
SELECT doc_id, domain, lang, source, CAST(ep AS INT) AS epoch, n_tokens, CAST(CASE WHEN ep < n_full THEN n_tokens ELSE least(n_tokens, remains - start) END AS BIGINT) AS take_tokens FROM x"""
