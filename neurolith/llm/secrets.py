"""Secret scans with multipart credential linking: weak parts are reported only beside complementary ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.llm.common import sheltered

#: Fixed patterns of the base kinds. Maximal runs make the length bounds of access and hex safe inside the pattern. A look at
#: the first character spares most places the alternatives.
ASSIGN = r"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: alone they say nothing.
ENDPOINT = r"""(?=[hfsjpmra])(?:https?|ftp|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>|]+"""
IDENTIFIER = r"""(?=[UuLlCcAa])(?i:(user(?:name)?|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
#: Kind, pattern, role, least length of group 2 (0: no such test), a string in every match; the first three are the base.
KINDS = (
    ("assign", ASSIGN, "secret", 6, ""),
    ("access", ACCESS, "identifier", 0, "AKIA"),
    ("hex", HEX, "secret", 0, ""),
    ("linked_endpoint", ENDPOINT, "endpoint", 0, "://"),
    ("linked_identifier", IDENTIFIER, "identifier", 3, ""),
    ("linked_secret", OPAQUE, "secret", 0, ""),
)
STRONG = 3
SECRETS = tuple(k for k, kind in enumerate(KINDS) if kind[2] == "secret")
_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_MARK, _OTHER = "\x01", "\x02"
_FAR = 1 << 60
#: Code points in a block of a text that is cut at many places.
_BLOCK = 1024


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it, in log2(size) rounds that double how far back a value has looked."""
    add = lambda a, s: F.transform(a, lambda x, i: F.when(i >= s, join(F.get(a, F.greatest(i - s, F.lit(0))), x)).otherwise(x))
    return _let(values, lambda v: F.aggregate(F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda s: s < F.size(v)), v, add))


def _ahead(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all after it."""
    return F.reverse(_running(F.reverse(values), join))


def _found(k: int, text: Column) -> Column:
    """Leftmost non-overlapping matches of kind k as (kind, start, end) in code points.

    Matches are fenced with a mark that the text has lost beforehand (another control character stands in for it), the text
    is cut at the fences, and running lengths give the places.
    """
    _, pattern, _, least, holds = KINDS[k]
    fenced = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{_MARK}$0{_MARK}"), _MARK)

    def spans(parts: Column) -> Column:
        good = lambda part, i: (i % 2 == 1) & (F.length(F.regexp_extract(part, pattern, 2)) >= least if least else F.lit(True))
        ends = _running(F.transform(parts, lambda part: F.length(part).cast("long")), lambda a, b: a + b)
        place = lambda end: F.transform(parts, lambda part, i: F.when(good(part, i), F.struct(F.lit(k).alias("kind"), (F.get(end, i) - F.length(part)).alias("start"), F.get(end, i).alias("end"))))
        return F.filter(_let(ends, place), lambda s: s.isNotNull())

    return F.when(text.contains(holds) & text.rlike(pattern) if holds else text.rlike(pattern), _let(fenced, spans)).otherwise(F.array()).cast(_SPANS)


def _linked(parts: Column, scope: int) -> Column:
    """Of parts (start, kind, end), sorted, the strong ones and each weak one whose scope meets a part that completes it.

    The interval join is a merge over the sorted parts: the largest end among those before and the least start among those
    after say whether an interval meets any of them.
    """
    weak = lambda s: s["kind"] >= STRONG
    secret = lambda s: s["kind"].isin(*SECRETS)
    end_of = lambda p, is_: _running(F.transform(p, lambda s: F.when(is_(s), s["end"]).otherwise(F.lit(-_FAR))), F.greatest)
    start_of = lambda p, is_: _ahead(F.transform(p, lambda s: F.when(is_(s), s["start"]).otherwise(F.lit(_FAR))), F.least)
    meets = lambda s, i, before, after, by: (F.get(before, i) > s["start"] - by) | (F.get(after, i) < s["end"] + by)

    def apart(p: Column) -> Column:  # weak parts that overlap a strong one are that one
        strong = lambda s: ~weak(s)
        return _let(F.struct(end_of(p, strong).alias("b"), start_of(p, strong).alias("a")), lambda x: F.filter(p, lambda s, i: strong(s) | ~meets(s, i, x["b"], x["a"], 0)))

    def completed(p: Column) -> Column:
        other = lambda s: ~secret(s)
        sides = F.struct(end_of(p, secret).alias("sb"), start_of(p, secret).alias("sa"), end_of(p, other).alias("ob"), start_of(p, other).alias("oa"))
        near = lambda s, i, x: F.when(secret(s), meets(s, i, x["ob"], x["oa"], scope)).otherwise(meets(s, i, x["sb"], x["sa"], scope))
        return _let(sides, lambda x: F.filter(p, lambda s, i: ~weak(s) | near(s, i, x)))

    return F.when(F.exists(parts, weak), _let(_let(parts, apart), completed)).otherwise(parts)


def secret_spans(docs: DataFrame, *, text: str = "text", out: str = "secrets", scope: int = 200) -> DataFrame:
    """Add out, an array of (kind, start, end): every base span, and each weak part that something completes.

    kind is a place in KINDS, start and end are code points, end exclusive; sorted by start, then kind. A part's scope is
    scope characters to either side. A weak endpoint or identifier is reported if a secret's interval meets its scope; a
    weak secret if an identifier or endpoint does. Weak parts that overlap a base span are that span and not reported again.

    One scan, no shuffle: a row's answer depends on its text alone. The interval join within a text is a merge over its
    sorted parts, n log n in their number, so very long texts with many parts are in order. Nulls and empty texts have no
    spans; parts that start together count on either side; repeated rows get the same spans each; an empty table gives an
    empty one; all other columns pass through, whatever their names, but one named like out is replaced.
    """
    d, back = sheltered(docs.drop(out), text)
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_MARK), F.lit(_OTHER))
    found = _let(body, lambda t: F.concat(*[_found(k, t) for k in range(len(KINDS))]))
    parts = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = _let(parts, lambda p: F.transform(_linked(p, scope), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return back(d.withColumn("_spans", spans), {out: "_spans"})


def redact(docs: DataFrame, *, text: str = "text", spans: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """Replace what the spans (as of secret_spans, sorted by start) cover in each text; overlapping and touching ones become one mask.

    A text is cut in blocks of code points, so that many spans in a very long text cost no more than its length and theirs.
    Nulls and texts without spans stay as they are; repeated rows are redacted alike; an empty table gives an empty one;
    all other columns pass through, whatever their names.
    """
    d, back = sheltered(docs, text, spans)
    t, s = F.col(text), F.col(spans)

    def merged(x: Column) -> Column:  # x: the largest end so far, span by span
        first = F.filter(s, lambda a, i: (i == 0) | (a["start"] > F.get(x, F.greatest(i - 1, F.lit(0)))))
        last = F.filter(x, lambda e, i: F.coalesce(F.get(s, i + 1)["start"] > e, F.lit(True)))
        return _let(last, lambda ends: F.transform(first, lambda a, i: F.struct(a["start"].alias("start"), F.get(ends, i).alias("end"))))

    def cut_out(blocks: Column, begin: Column, end: Column) -> Column:
        of = lambda at: F.floor(at / _BLOCK).cast("int")
        part = lambda i, lo, hi: F.substring(F.coalesce(F.get(blocks, i), F.lit("")), (lo + 1).cast("int"), (hi - lo).cast("int"))
        i, j = of(begin), of(end)
        many = F.concat(part(i, begin % _BLOCK, F.lit(_BLOCK)), F.when(j > i + 1, F.array_join(F.slice(blocks, i + 2, j - i - 1), "")).otherwise(F.lit("")), part(j, F.lit(0), end % _BLOCK))
        return F.when(i == j, part(i, begin % _BLOCK, end % _BLOCK)).otherwise(many)

    def masked(m: Column) -> Column:
        def pieces(blocks: Column) -> Column:
            end = F.length(t).cast("long")
            kept = F.transform(m, lambda a, i: cut_out(blocks, F.when(i > 0, F.get(m, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0).cast("long")), a["start"]))
            return F.concat(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(mask))), ""), cut_out(blocks, F.get(m, F.size(m) - 1)["end"], end))

        return _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), pieces)

    ends = _running(F.transform(s, lambda a: a["end"]), F.greatest)
    return back(d.withColumn(text, F.when(F.size(s) > 0, _let(_let(ends, merged), masked)).otherwise(t)))


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with their found secrets masked and n_chars after the new text; other columns as they are, whatever their names.

    Null texts stay null (n_chars null), empty ones empty; repeated rows are redacted alike; an empty table gives an empty one.
    """
    d, back = sheltered(docs, "text", "n_chars")
    d = redact(secret_spans(d, out="spans"), spans="spans").drop("spans")
    return back(d.withColumn("n_chars", F.length("text").cast("long")))


def scan_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans; nulls, repeats and empty tables: as in secret_spans."""
    docs, _ = sheltered(docs, "doc_id", "text")
    d = secret_spans(docs.select("doc_id", "text")).drop("text")
    name = F.array(*[F.lit(kind[0]) for kind in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] < STRONG)
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
