"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import WORD, sheltered

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: A line needs a mark that ends a sentence, before white space, a closing quote or bracket, or the line's end.
SENTENCE_END = r"[.!?:;…。]([\s\"'”’»)\]*]|$)"
#: Navigation: menus and breadcrumbs, three or more short items between bars, arrows or dots in a row.
NAVIGATION = r"(^|[|>»·•])[^|>»·•.!?]{0,60}[|>»·•][^|>»·•.!?]{0,60}[|>»·•]|^\s*(home|menu|login|sign in|sign up|next|previous|back to top|skip to content|read more|share)\s*$"
#: Boilerplate: notices that pages repeat around their text.
BOILERPLATE = r"(all rights reserved|copyright \(c\)|copyright ©|cookie policy|we use cookies|accept cookies|enable javascript|terms of (use|service)|privacy policy|lorem ipsum|subscribe to our|click here|licensed under the|is licensed under)"
WINDOW = 8


def line_fails(line: Column, most_marks: float = 0.1) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule. Blank lines never do."""
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS + "!?", ""))
    punctuation = ~line.rlike(SENTENCE_END) | (marks > most_marks * F.length(line))
    low = F.lower(line)
    return line.rlike(r"[^\x20\x09-\x0D]") & (punctuation | low.rlike(NAVIGATION) | low.rlike(BOILERPLATE))


def clean_lines(docs: DataFrame, *, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Add clean_text, n_lines, n_failed_lines (long), lost (share of word characters in failed lines) and line_kept.

    A document is kept by this rule if lost <= most_lost. Null and empty texts have no lines, lose nothing (lost is 0) and
    are kept here; very long texts are judged whole; a row depends on itself alone, so ties and repeated rows stay as they
    are, and an empty table gives an empty one. All other columns pass through, whatever their names; only columns named like
    an added one are replaced.
    """
    added = ("clean_text", "n_lines", "n_failed_lines", "lost", "line_kept")
    docs, back = sheltered(docs.drop(*added), text)
    solid = lambda s: F.length(F.translate(s, SPACES, ""))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = docs.withColumn("_lines", lines)
    out = out.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    out = out.withColumn("clean_text", F.when(F.col(text).isNotNull(), F.array_join("_good", "\n")))
    all_, left = solid(F.coalesce(F.col(text), F.lit(""))), solid(F.coalesce(F.col("clean_text"), F.lit("")))
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_failed_lines", (F.size("_lines") - F.size("_good")).cast("long"))
    out = out.withColumn("lost", F.when(all_ > 0, (all_ - left) / all_).otherwise(F.lit(0.0)))
    return back(out.withColumn("line_kept", F.col("lost") <= most_lost), {x: x for x in added})


def _windows() -> Column:
    """A hash of every run of WINDOW words, from the array of the words' hashes in _h."""
    at = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])
    return F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def quality_rules(docs: DataFrame, *, least_words: int = 20, most_repeat: int = 30, most_lost: float = 0.5) -> DataFrame:
    """documents -> doc_id, the base counts, base_failed, kept, and the line rules' figures.

    All of it is per row and stays in one scan without a shuffle: repeated 8-word windows are found by a hash of each window
    within its document; only documents that have any (their distinct windows are fewer) sort theirs. Nulls count as empty
    texts and fail for want of words; very long texts count whole; repeated rows are judged alike; an empty table gives an
    empty one; other columns, whatever their names, are not looked at.
    """
    docs, _ = sheltered(docs, "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    d = clean_lines(docs.select("doc_id", "text"), most_lost=most_lost)
    d = d.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), 0))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("_filled", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda c: F.length(c).cast("long")
    d = d.select(
        "doc_id", F.size("_h").cast("long").alias("n_words"), count(F.translate(body, SPACES, "")).alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long").alias("n_dup_lines"),
        "n_lines", "n_failed_lines", "lost", "line_kept", _windows().alias("_w"),
    )
    d = d.withColumn("_again", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, by: F.coalesce((i + by >= 0) & (F.get("_again", F.greatest(i + by, F.lit(0)))["h"] == x["h"]), F.lit(False))
    d = d.withColumn("_pos", F.sort_array(F.transform(F.filter("_again", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])))
    step = F.transform("_pos", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_pos", i + 1), p + WINDOW) - p))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & F.col("line_kept"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", F.round("lost", 6).alias("lost"))


def oracle() -> str:
    sp = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    q = lambda s: s.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT *, list_filter(lines, lambda x: NOT (regexp_matches(x, '{q(WORD)}') AND (
        NOT regexp_matches(x, '{q(SENTENCE_END)}') OR (length(x) - length(translate(x, '{SYMBOLS}!?', ''))) > 0.1 * length(x)
        OR regexp_matches(lower(x), '{q(NAVIGATION)}') OR regexp_matches(lower(x), '{q(BOILERPLATE)}')))) AS good,
      list_filter(lines, lambda x: regexp_matches(x, '{q(WORD)}')) AS filled, regexp_extract_all(t, '{q(WORD)}') AS w FROM l),
b AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {sp}, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
      CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
      CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(good) AS BIGINT) AS n_failed_lines,
      length(translate(t, {sp}, '')) AS c, length(translate(array_to_string(good, chr(10)), {sp}, '')) AS k FROM g),
p AS (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW}),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(w, i, i + {WINDOW - 1})) AS n FROM p),
s AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + {WINDOW}) - i) AS x FROM r WHERE n > 1),
n AS (SELECT rid, CAST(sum(x) AS BIGINT) AS n_repeat_words FROM s GROUP BY rid),
f AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN c > 0 THEN (c - k) / c ELSE 0.0 END AS lost FROM b LEFT JOIN n USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 AS kept,
       n_lines, n_failed_lines, round(lost, 6) AS lost FROM f"""
