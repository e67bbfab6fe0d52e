"""Secret scans that link the parts of a credential.

Strong findings stand alone: assignments of long values, access identifiers
and long hexadecimal runs.  Weak candidates (a short assigned value, a bare
random-looking run, an endpoint) are worth nothing alone; one is reported if a
complementary part begins or ends within ``SCOPE`` characters of it: an access
identifier for a bare secret, a user or identifier and a secret for an
endpoint, and so on.  Parts and scopes are joined as intervals: characters are
dealt into cells as wide as a scope, and a candidate meets the first and last
part of each kind in its own and the two neighbouring cells.

Everything is made of DataFrame functions.

Cases: null text counts as empty and has no finding; repeated rows have equal
findings; an empty table gives an empty result; thousands of parts in one text
stay near linear, as cells carry only their outermost parts and positions are
summed up in blocks; very long texts are scanned whole, and cut into blocks
before they are redacted; parts that begin together are ordered as their kinds
are listed; rows that agree in text share their links; other columns are not
looked at by :func:`scan`, and pass through :func:`redacted` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, load, looked_up, quoted, settled

#: Fixed patterns of the strong kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
STRONG = ("assign", "access", "hex")
#: Characters of an assigned value that make it strong, and weak.
LONG_VALUE, SHORT_VALUE = 12, 6
#: Weak candidates: a run of 40 characters as secret keys are, with both letters and digits; a host or URL of a service; a user name.
BARE = r"(?<![A-Za-z0-9/+=_-])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=_-])"
ENDPOINT = r"((?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh|ftp)://[^\s\"'<>]+|(?<![a-z0-9.-])[a-z0-9.-]{1,253}\.amazonaws\.com)"
USER = r"""((?i:username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+)"""
WEAK = ("short_value", "bare", "endpoint", "user")
#: Any one of these parts within the scope makes a weak candidate a finding.
COMPLEMENTS = {
    "short_value": ("user", "endpoint", "access"),
    "bare": ("access", "user"),
    "endpoint": ("assign", "access", "short_value"),
    "user": ("assign", "short_value", "bare"),
}
#: Characters between a candidate and its complement, at most.
SCOPE = 200
#: Items that are summed up together, and characters of a block of text.
ITEMS, BLOCK = 256, 4096
_SPANS = "array<struct<begin:int,end:int>>"


def running(items: Column, told: Callable[[Column, Column], Column], moved: Callable[[Column, Column], Column]) -> tuple[Column, Column]:
    """What ``told`` says of each item and the place reached before it, a span; and the place reached at last.

    ``moved`` gives the place after an item.  Items are taken in blocks, so that no long array is copied at each step.
    """
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / ITEMS), F.lit(0)).cast("int")), lambda k: F.slice(items, k * ITEMS + 1, F.lit(ITEMS)))
    state = lambda at, found: F.struct(at.alias("at"), found.alias("found"))
    empty = F.array().cast(_SPANS)

    def block(done: Column, part: Column) -> Column:
        step = lambda s, x: state(moved(s["at"], x), F.concat(s["found"], F.array(told(s["at"], x))))
        return F.concat(done, F.array(F.aggregate(part, state(F.element_at(done, -1)["at"], empty), step)))

    blocks = F.aggregate(cut, F.array(state(F.lit(0), empty)), block)
    return F.flatten(F.transform(blocks, lambda x: x["found"])), F.element_at(blocks, -1)["at"]


def _span(begin: Column, end: Column) -> Column:
    return F.struct(begin.alias("begin"), end.alias("end"))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (begin, end) of a pattern's matches in code points, leftmost first.

    The text splits into the gaps between matches; the lengths of gaps and
    matches add up to positions.  Texts without a match are not split.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    walked, _ = running(pairs, lambda at, p: _span(at + p["gap"], at + p["gap"] + p["size"]), lambda at, p: at + p["gap"] + p["size"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPANS))


def parts_of(text: Column) -> Column:
    """Array of all parts of a text: (kind, begin, end), strong and weak."""
    kind = lambda spans, name: F.transform(spans, lambda s: F.struct(F.lit(name).alias("kind"), s["begin"].alias("begin"), s["end"].alias("end")))
    assigned = F.when(text.rlike(ASSIGN), F.arrays_zip(spans_of(text, ASSIGN).alias("span"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("value")))
    assigned = F.coalesce(assigned, F.array().cast("array<struct<span:struct<begin:int,end:int>,value:string>>"))
    of_length = lambda low, high: F.transform(F.filter(assigned, lambda a: F.length(a["value"]).between(low, high)), lambda a: a["span"])
    return F.concat(
        kind(of_length(LONG_VALUE, 1 << 30), "assign"),
        kind(spans_of(text, ACCESS), "access"),
        kind(spans_of(text, HEX), "hex"),
        kind(of_length(SHORT_VALUE, LONG_VALUE - 1), "short_value"),
        kind(spans_of(text, BARE), "bare"),
        kind(spans_of(text, ENDPOINT), "endpoint"),
        kind(spans_of(text, USER), "user"),
    )


def linked(parts: DataFrame) -> DataFrame:
    """The weak candidates of ``parts`` (key, kind, begin, end) that have a complement within the scope.

    The interval join: each side is dealt by key and cell; the side of
    complements is reduced to its outermost part per kind and cell first.
    """
    cell = lambda c: F.floor(F.col(c) / SCOPE).cast("int")
    ends = parts.select("key", "kind", F.explode(F.array(F.struct(cell("begin").alias("cell"), F.col("begin").alias("at")), F.struct(cell("end").alias("cell"), F.col("end").alias("at")))).alias("x"))
    outer = ends.groupBy("key", "kind", F.col("x.cell").alias("cell")).agg(F.min("x.at").alias("low"), F.max("x.at").alias("high"))
    pairs = F.array(*[F.struct(F.lit(w).alias("weak"), F.lit(c).alias("part")) for w, cs in COMPLEMENTS.items() for c in cs])
    weak = parts.filter(F.col("kind").isin(*WEAK)).withColumn("part", F.explode(F.transform(F.filter(pairs, lambda p: p["weak"] == F.col("kind")), lambda p: p["part"])))
    weak = weak.withColumn("cell", F.explode(F.sequence(cell("begin") - 1, cell("end") + 1)))
    w, o = weak.alias("w"), outer.alias("o")
    near = (F.col("o.low") <= F.col("w.end") + SCOPE) & (F.col("o.high") >= F.col("w.begin") - SCOPE)
    met = w.join(o, (F.col("w.key") == F.col("o.key")) & (F.col("w.part") == F.col("o.kind")) & (F.col("w.cell") == F.col("o.cell")) & near)
    return met.select("w.key", "w.kind", "w.begin", "w.end").distinct()


def _is(kinds: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda p: p["kind"].isin(*kinds)


def _with_links(rows: DataFrame, spread: Column) -> DataFrame:
    """``rows`` (key, parts, ...), settled, with ``found``: the strong parts, and the weak ones that have a complement."""
    strong = F.filter("parts", _is(STRONG))
    weak = F.exists("parts", _is(WEAK))
    links = linked(rows.filter(weak).select("key", "parts").dropDuplicates(["key"]).select("key", F.inline("parts")))
    added = links.groupBy("key").agg(F.collect_list(F.struct("kind", "begin", "end")).alias("added"))
    met = looked_up(rows.filter(weak), added, "key", spread)
    found = F.concat(strong, F.coalesce("added", F.array().cast("array<struct<kind:string,begin:int,end:int>>")))
    return met.withColumn("found", found).drop("added").unionByName(rows.filter(~weak).withColumn("found", strong))


def _ordered(parts: Column | str) -> Column:
    order = {k: i for i, k in enumerate((*STRONG, *WEAK))}
    number = lambda kind: F.element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), kind)
    return F.array_sort(F.transform(parts, lambda p: F.struct(p["begin"].alias("begin"), number(p["kind"]).alias("place"), p["end"].alias("end"), p["kind"].alias("kind"))))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, key (digest of the text), base and found: arrays of (begin, place, end, kind) in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settled(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("key"), parts_of(body).alias("parts")))
    found = _with_links(rows, F.col("doc_id"))
    return found.select("doc_id", "key", _ordered(F.filter("parts", _is(STRONG))).alias("base"), _ordered("found").alias("found"))


def as_text(parts: Column) -> Column:
    """``kind:begin:end`` of each part, joined by commas."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["begin"], p["end"])), ",")


def _without(body: Column, found: Column, mark: str) -> Column:
    """The text with the spans, overlapping ones together, replaced: what lies between them, joined by ``mark``."""
    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    block = lambda at: F.floor(at / BLOCK).cast("int")

    def between(x: Column) -> Column:
        """Characters from ``begin`` to ``end``, from the blocks that they lie in."""
        own = F.slice(blocks, block(x["begin"]) + 1, F.greatest(block(x["end"] - 1) - block(x["begin"]) + 1, F.lit(0)))
        low = lambda i: F.greatest(x["begin"] - (block(x["begin"]) + i) * BLOCK, F.lit(0))
        high = lambda i: F.least(x["end"] - (block(x["begin"]) + i) * BLOCK, F.lit(BLOCK))
        return F.array_join(F.transform(own, lambda b, i: F.substring(b, low(i) + 1, high(i) - low(i))), "")

    gaps, last = running(found, lambda at, p: _span(at, p["begin"]), lambda at, p: F.greatest(at, p["end"]))
    kept = F.concat(F.filter(gaps, lambda x: x["begin"] <= x["end"]), F.array(_span(last, F.length(body))))
    return F.array_join(F.transform(kept, between), mark)


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding, overlapping ones together, replaced by ``mark``; texts without one stay as they are.

    Only texts with weak candidates are moved, to meet their links.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settled(docs.select(F.struct(*columns_of(docs)).alias("row"), F.sha2(body, 256).alias("key"), parts_of(body).alias("parts")))
    found = _with_links(rows, F.col(f"row.`{doc_id}`"))
    body = F.col(f"row.`{text}`")
    fresh = F.when(F.size("found") == 0, body).otherwise(_without(body, _ordered("found"), mark))
    return found.select(*[fresh.alias(c) if c == text else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, STRONG), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


def op2_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`op2_secret_scan` that are base findings."""
    return op2_secret_scan(spark, sf_dir).drop("spans")


def _kind_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
    regexp_split_to_array(t, '{pattern}') AS gap FROM d WHERE regexp_matches(t, '{pattern}')"""


_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
OP2_BASE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS ({_kind_sql(0, "assign", f"({_WORDS})" + ASSIGN.partition(")" + ")")[2], 2, LONG_VALUE)} UNION ALL {_kind_sql(1, "access", "AKIA[A-Z0-9]{14,}", 0, 18)} UNION ALL {_kind_sql(2, "hex", "[0-9a-f]{16,}", 0, 16)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM kinds),
placed AS (SELECT doc_id, place, kind, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, length(m[i]) AS n FROM each WHERE length(g[i]) >= least),
spans AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS c, count(*) FILTER (place = 2) AS h, string_agg(concat_ws(':', kind, b::BIGINT, (b + n)::BIGINT), ',' ORDER BY b, place) AS t FROM placed GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(spans.t, '')) AS base_sha256 FROM d LEFT JOIN spans USING (doc_id)
"""
