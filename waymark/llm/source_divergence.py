"""How the sources of a language differ in their words.

A task reads its texts with one table of bytes: ``bytes.translate`` lowers A-Z
and blanks all other ASCII in one pass, ``bytes.split`` gives the terms, and a
``Counter`` for each document their occurrences; a task sends sums by language,
source and term.  Spark adds them up sparsely: terms that a source lacks never
become rows.  The distance of two sources is the sum over all kept terms, yet
only rows of terms that one of them has are touched: what both lack adds the
same for each such term, what one lacks follows from how often each probability
occurs in the other, and only common terms meet in a join.

Cases: null text, language and source count as ''; a group of documents without
terms is a group still, with the same probability for each kept term; a
language without kept terms has distances of 0 and no rows of part ``term``;
repeated rows and rows with equal ids count each; very long texts are counted
whole, in a batch of their own; equal values are ranked by the bytes of the
item; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_bytes, load, sent_if_small, settled

#: Documents of its language that a term must occur in; what is added to each count; the whole that probabilities are parts of.
LEAST_DOCUMENTS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Ranks of terms that are reported.
TERMS = 50
#: Distinct terms that a task holds before it sends its sums.
HELD_TERMS = 300_000

#: A-Z to a-z; other ASCII but a-z to a blank; bytes of other letters as they are.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents): occurrences, and documents with any, of each term in each source of a language."""
    names = ["lang", "source", "term", "count", "documents"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, documents) in found.items():
                kinds = list(counts)
                own = [pa.array([lang] * len(kinds), pa.string()), pa.array([source] * len(kinds), pa.string()), pa.array(kinds, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*own, pa.array([counts[t] for t in kinds], pa.int64()), pa.array([documents[t] for t in kinds], pa.int64())], names)
            found.clear()

        for batch in in_bytes(batches, 2):
            for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = Counter(terms(data))
                counts, documents = found[lang, source]
                held -= len(counts)
                counts.update(own)
                documents.update(own.keys())
                held += len(counts)
            if held > HELD_TERMS:
                yield from sums()
                held = 0
        yield from sums()

    told = docs.mapInArrow(read, "lang string, source string, term string, count long, documents long")
    return told.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def _part(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * kept)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    top, below = wide((wide(count) + F.lit(ADDED)) * F.lit(WHOLE).cast("decimal(10,0)")), wide(wide(total) + wide(kept) * F.lit(ADDED))
    return F.call_function("div", top, below) + 1


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language and its distance; part
    ``term``: the terms, ``most`` at most, that the source uses more than its
    language does, by how much.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    every = settled(cells(docs))
    vocabulary = every.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least)
    vocabulary = settled(vocabulary.select("lang", "term", "all"))
    kept = settled(every.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "count", "all"))

    # Sources with the sums of their kept terms; one row a group, however many documents it has.
    whole = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")])
    groups = settled(groups.withColumn("none", F.when(F.col("kept") > 0, _part(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))))
    groups = sent_if_small(groups)

    found = kept.join(groups, ["lang", "source"]).withColumns({"p": _part(F.col("count"), F.col("total"), F.col("kept")), "q": _part(F.col("all"), F.col("lang_total"), F.col("kept"))})
    found = settled(found.select("lang", "source", "term", "p", "none", (F.col("p") - F.col("q")).alias("more")))

    top = _ranked(found.filter("more > 0").select("lang", "source", F.col("term").alias("item"), F.col("more").alias("value"))).filter(F.col("rank") <= most)
    pairs = _ranked(_distances(found, groups))
    columns = ("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.select(*columns).unionAll(top.select(*columns[:2], F.lit("term").alias("part"), *columns[3:]))


def _distances(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum over all kept terms of how far the probabilities of two sources are apart."""
    far = lambda a, b: F.abs(F.col(a) - F.col(b))
    own = groups.select("lang", "source", "none", "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    # What no source has; then what this one has; both as if the other had nothing.
    base = own.join(other, "lang").filter("source <> item").select("lang", "source", "item", (far("none", "other_none") * F.col("kept")).alias("value"))
    levels = found.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    single = levels.join(other, "lang").filter("source <> item").select("lang", "source", "item", ((far("p", "other_none") - far("none", "other_none")) * F.col("n")).alias("value"))
    mirrored = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # What both have, once for each two sources.
    left = found.select("lang", "term", "source", "p", "none")
    right = found.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("none").alias("other_none"))
    met = left.join(right, ["lang", "term"]).filter("source < item")
    both = met.groupBy("lang", "source", "item").agg(F.sum(far("p", "other_p") - far("p", "other_none") - far("none", "other_p") + far("none", "other_none")).alias("value"))
    turned = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    sums = base.unionAll(single).unionAll(mirrored).unionAll(both).unionAll(turned)
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
numbered AS (SELECT row_number() OVER () AS d, lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM docs),
words AS (SELECT d, lang, source, unnest(w) AS term FROM numbered),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS all_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, all_n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
parts AS MATERIALIZED (SELECT d.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY d.lang, source) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (total + 5 * v)::HUGEINT AS q FROM dense d JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM parts a JOIN parts b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)) AS rank FROM parts WHERE n > 0 AND p > q) WHERE rank <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""
