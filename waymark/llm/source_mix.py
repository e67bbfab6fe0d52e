"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words.  Every document of the source then
expects target / source size copies; the expectations are summed up along a
fixed order of the source's documents, one random offset is added, and a
document is emitted once for each integer that its stretch of the sum crosses.

Cases: null or empty text has size 0 and is drawn like any other document; a
null source is a source of its own, last in order; repeated rows stand side by
side in the order and each gets its own count; a source without words has
target 0 and nothing is taken; very long texts are counted whole; rows equal in
id and text are told apart by a hash of all their columns; an empty table gives
an empty result.  Other columns pass through :func:`mix` untouched, but columns
named like those it adds (size, source_size, target, copies, and names that
begin with ``_mix``) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, quoted, settled

WEIGHTS = (5, 2, 1)
#: Target words over all words.
SHARE = 1.5
#: Target over size of a source, at most; so also copies of a document.
MOST = 2.0
SEED = 42
#: Documents of one source and size class are ordered in cells of the hash; about so many stand in one, were all rows of one class.
CELL_ROWS = 20_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("~")) for p in parts])), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size), one row a source, with its weight and target.

    The total is shared by weight; no target exceeds ``most`` times its
    source's size, and what is cut off is shared again until none does.  So
    target = min(most * size, level * weight) for one level; sources are cut
    off in order of size over weight, which one window over sources finds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cut = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = cut.rowsBetween(Window.unboundedPreceding, -1), cut.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sizes.withColumn("weight", weight).withColumn("total", total)
    # The level if exactly the sources before this one are cut off.
    level = (F.col("total") * share - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * most).withColumn("nth", F.row_number().over(cut))
    first = F.min(F.when(F.col("free"), F.struct("nth", "level"))).over(Window.partitionBy())
    found = ranked.withColumn("level", first["level"])
    target = F.least(F.col("source_size") * most, F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return found.select("source", "source_size", "weight", target.alias("target"))


def size_class(size: Column) -> Column:
    """A class of similar sizes: the number of binary digits and the three after the first."""
    digits = F.length(F.bin(size))
    return digits * 8 + F.when(digits >= 4, F.conv(F.substring(F.bin(size), 2, 3), 2, 10).cast("int")).otherwise(F.lit(0))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies of each document.

    The order within a source: size class, then a hash; so every stretch of it
    holds all kinds of documents of about one size.  The sum is built from
    levels (size classes, cells of the hash, documents), and the cells are the
    smaller the more rows there are, so no task gathers a source.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.coalesce(F.col(text), F.lit("~"))))
    digits = max(2, math.ceil(math.log(max(1, docs.count()) / CELL_ROWS, 16)))  # of the hash that name a cell
    own = ["size", "source_size", "target", "copies"]
    kept = [c for c in docs.columns if c not in own and not c.startswith("_mix")]
    keys = {"_mix_class": size_class(F.col("size")), "_mix_cell": F.substring("_mix_place", 1, digits)}
    kept = [F.col(quoted(c)) for c in kept]
    # Maps have no hash of their own, but one of their text.
    told = [F.to_json(F.struct(c)) if "map<" in kind else c for c, kind in zip(kept, (x.dataType.simpleString() for x in docs.select(*kept).schema), strict=True)]
    rows = docs.select(*kept, n_words(text).alias("size"), place.alias("_mix_place"), F.xxhash64(*told).alias("_mix_row")).withColumns(keys)
    light = docs.select(F.col(source).alias("source"), n_words(text).alias("size"), place.alias("_mix_place")).withColumns(keys)
    cells = settled(light.groupBy("source", "_mix_class", "_mix_cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    classes = cells.groupBy("source", "_mix_class").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.withColumn("class_start", F.coalesce(F.sum("n").over(before("source", "_mix_class")), F.lit(0))).drop("n", "words")
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["*"], "source_size", "target")
    # Cells of one class may be many: their running sum is taken by the first digits, then within them.
    coarse = cells.groupBy("source", "_mix_class", F.substring("_mix_cell", 1, digits // 2).alias("_mix_part")).agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("part_start", F.coalesce(F.sum("n").over(before("source", "_mix_class", "_mix_part")), F.lit(0))).drop("n")
    cells = cells.withColumn("_mix_part", F.substring("_mix_cell", 1, digits // 2))
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("n").over(before("source", "_mix_class", "_mix_part", "_mix_cell")), F.lit(0))).drop("n", "words")
    cells = cells.alias("c").join(coarse.alias("p"), F.expr("c.source <=> p.source and c._mix_class = p._mix_class and c._mix_part = p._mix_part")).select("c.*", "part_start")
    cells = cells.alias("c").join(starts.alias("s"), F.expr("c.source <=> s.source and c._mix_class = s._mix_class"))
    start = F.col("class_start") + F.col("part_start") + F.col("cell_start")
    cells = cells.select(F.col("c.source").alias("_mix_source"), F.col("c._mix_class").alias("_mix_class"), F.col("c._mix_cell").alias("_mix_cell"), start.alias("_mix_start"), "source_size", "target")
    nth = F.row_number().over(Window.partitionBy(source, "_mix_class", "_mix_cell").orderBy("_mix_place", "_mix_row"))
    p, c = rows.withColumn("_mix_nth", nth).alias("p"), cells.alias("c")
    same = F.col(f"p.{source}").eqNullSafe(F.col("c._mix_source")) & (F.col("p._mix_class") == F.col("c._mix_class")) & (F.col("p._mix_cell") == F.col("c._mix_cell"))
    joined = p.join(c, same).select("p.*", "_mix_start", "source_size", "target")
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    upto = F.col("_mix_start") + F.col("_mix_nth")
    offset = fraction(F.lit(str(seed)), F.lit("offset"), F.col(source))
    copies = F.floor(upto * expected + offset) - F.floor((upto - 1) * expected + offset)
    return joined.withColumn("copies", copies.cast("long")).drop("_mix_start", "_mix_nth", "_mix_place", "_mix_row", "_mix_class", "_mix_cell")


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix` as many times as it has copies."""
    return mixed.filter("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_mix_copy")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(text, '~')) AS place
  FROM documents),
keyed AS (
  SELECT *, length(bin(size)) * 8 + CASE WHEN size >= 8 THEN (size // (1::BIGINT << (length(bin(size)) - 4)::INT)) % 8 ELSE 0 END AS class FROM docs),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
         sum(source_size) OVER () AS total FROM sizes),
levels AS (
  SELECT *, (total::DOUBLE * 1.5 - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS nth FROM weighed),
found AS (SELECT *, arg_min(level, nth) FILTER (level * weight <= source_size * 2.0::DOUBLE) OVER () AS lowest FROM levels),
goals AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(lowest, 'inf'::DOUBLE) * weight) AS target FROM found),
placed AS (
  SELECT k.*, g.source_size, g.target, row_number() OVER (PARTITION BY k.source ORDER BY class, place) AS nth,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END AS expected,
         ('0x' || substr(md5('42:offset:' || coalesce(k.source, '~')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS start
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       ((floor(nth::DOUBLE * expected + start) - floor((nth - 1)::DOUBLE * expected + start)) * size)::BIGINT AS taken
FROM placed
"""
