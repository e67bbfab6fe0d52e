"""Exact top-k search by inner product, bucketed by length.

Vectors are grouped by length, lengths of a bucket within a factor of each
other.  A query that already knows k good scores asks of a bucket how large
the cosine to one of its vectors must be to still matter.  Buckets where no
cosine is large enough are left out; in the others candidates are kept by
length alone, or, where the cosine must be large, by the range that the
query's largest coordinates leave to theirs.  Exact products of the candidates
decide.

The queries' first scores come from the longest vectors.  Queries and vectors
are both dealt into blocks of bounded size, queries with others that need
vectors of about the same length.  A block of vectors is sent to those blocks
of queries only in which some query still wants its bucket.

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of another dimension than the query's do not meet it; zero
vectors have score 0; scores are whole numbers of 64 bits, larger ones become
the largest of them; ties go to the smaller id; a repeated id is found once for
each row, and never by a query of that id; rows that agree in id and vector are
one query, rows of one id with unlike vectors are queries of their own, each
with its ranks; rows with a null id take no part; fewer vectors than k give all
of them; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, settled

K = 5
#: Each component becomes floor(SCALE * component).
SCALE = 256
#: Largest length over smallest in a bucket.
RATIO = 1.05
#: Rows of a block of queries and of a block of vectors, about.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Classes of queries by the length of the vectors that they need, at most.
NEEDS = 32
#: A bucket is searched by coordinates where the cosine must be this at least; so many of the query's largest are used.
BY_COORDINATE, COORDINATES = 0.5, 4
#: Products below this are exact in 64-bit floats; larger ones are made of Python's integers.
EXACT = float(1 << 52)


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, norm) of the rows that take part; v are whole numbers, kept as doubles."""
    given = F.col(embedding)
    finite = F.coalesce(F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    taken = rows.filter(finite & F.col(vec_id).isNotNull() & (F.size(given) > 0))
    scaled = F.transform(given, lambda x: F.rint(F.floor(x.cast("double") * SCALE).cast("double")))
    taken = taken.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))
    return taken.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def bucket_of(norm: Column) -> Column:
    return F.when(norm < 1, F.lit(-1)).otherwise(F.floor(F.log(norm) / math.log(RATIO))).cast("int")


def candidates(q: np.ndarray, q_norm: float, least: float, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of a bucket that may reach ``least``: by length, or by the query's largest coordinates."""
    if least <= 0 or q_norm == 0:
        return np.arange(len(v))
    longest = norms.max()
    cosine = least / (q_norm * longest) if longest else 2.0
    if cosine > 1 + 1e-9:
        return np.empty(0, np.int64)
    kept = np.flatnonzero(norms * q_norm >= least * (1 - 1e-9))
    if cosine < BY_COORDINATE or not len(kept):
        return kept
    unit = q / q_norm
    for f in np.argsort(-np.abs(unit), kind="stable")[:COORDINATES]:
        # unit[f] * p + sqrt(1 - unit[f]^2) * sqrt(1 - p^2) has to reach the cosine.
        angle, room = math.acos(max(-1.0, min(1.0, unit[f]))), math.acos(min(1.0, cosine))
        low, high = math.cos(min(math.pi, angle + room)), math.cos(max(0.0, angle - room))
        p = v[kept, f] / norms[kept]
        kept = kept[(p >= low - 1e-9) & (p <= high + 1e-9)]
        if not len(kept):
            break
    return kept


def best_of(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best of a block of vectors for each of a block of queries."""
    out = {"query_id": [], "own": [], "vec_id": [], "score": []}
    by_size: dict[int, list[int]] = {}
    lists = vectors.column("v").combine_chunks()
    for row, n in enumerate(np.diff(lists.offsets.to_numpy())):
        by_size.setdefault(int(n), []).append(row)
    blocks = {}
    for n, rows in by_size.items():
        part = lists.take(pa.array(rows))
        blocks[n] = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, n), np.array(rows)
    ids, norms = vectors.column("vec_id").to_numpy(), vectors.column("norm").to_numpy()
    for query in queries.to_pylist():
        q = np.array(query["v"])
        if len(q) not in blocks:
            continue
        v, rows = blocks[len(q)]
        least = query["least"] if query["least"] is not None else -math.inf
        kept = candidates(q, query["norm"], least, v, norms[rows])
        kept = kept[ids[rows[kept]] != query["query_id"]]
        if not len(kept):
            continue
        if query["norm"] * norms[rows[kept]].max() < EXACT:
            score = (v[kept] @ q).astype(np.int64)
        else:
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, q, strict=True)))) for x in v[kept]], np.int64)
        found = ids[rows[kept]]
        top = np.lexsort((found, -score))[:k]
        top = top[score[top] >= least] if least > -math.inf else top
        out["query_id"] += [query["query_id"]] * len(top)
        out["own"] += [query["own"]] * len(top)
        out["vec_id"] += found[top].tolist()
        out["score"] += score[top].tolist()
    return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})


def _met(queries: DataFrame, vectors: DataFrame, blocks: list[tuple[int, int, float]], n_queries: int, k: int) -> DataFrame:
    """Every block of queries with those blocks of vectors that may still matter to one of its queries."""
    wanted = F.filter(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("salts"), F.lit(m).alias("longest")) for b, s, m in blocks]), lambda x: F.col("least").isNull() | (F.col("norm") * x["longest"] * (1 + 1e-9) >= F.col("least")))
    # Queries that need vectors of a like length share a block.
    need = F.col("least") / F.greatest("norm", F.lit(1.0))
    steps = queries.agg(F.percentile_approx(need, [i / NEEDS for i in range(1, min(NEEDS, n_queries))], 1000)).first()[0] if 1 < n_queries else None
    band = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x < need)) if steps else F.lit(0)
    parts = -(-n_queries // min(NEEDS, n_queries))
    placed = queries.withColumn("qb", F.coalesce(band, F.lit(0)) * parts + F.pmod(F.xxhash64("query_id", "own"), F.lit(parts)).cast("int"))
    asked = placed.select("qb", F.explode(wanted).alias("x")).select("qb", "x.bucket", "x.salts").distinct()
    pairs = asked.select("qb", "bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = placed.withColumn("x", F.explode(wanted)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("x.salts") - 1)))
    q = dealt.select("query_id", "own", "v", "norm", "least", "qb", F.col("x.bucket").alias("bucket"), "salt")
    v = vectors.select("vec_id", "v", "norm", "bucket", "salt").join(pairs, ["bucket", "salt"]).select("vec_id", "v", "norm", "bucket", "salt", "qb")
    q, v = q.toDF(*q.columns), v.toDF(*v.columns)  # columns of their own, though both may come from one table
    key = ["qb", "bucket", "salt"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(left, right, k)

    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(search, "query_id long, own long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each of ``queries``, but those of its id.

    Both have vec_id, v and norm, as :func:`whole_vectors` makes them.
    """
    vectors = vectors.withColumn("bucket", bucket_of(F.col("norm")))
    # One row for each bucket; lengths are spread over a few hundred at most.
    sizes = sorted(((r.bucket, r.n, r.longest) for r in vectors.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()), reverse=True)
    # A query is known by its id and a hash of its vector.
    asked = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("own"), "v", "norm").dropDuplicates(["query_id", "own"])
    total = asked.count()
    empty = queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sizes or not total:
        return empty
    n_queries = -(-total // QUERY_BLOCK)
    salts = {b: -(-n // VECTOR_BLOCK) for b, n, _ in sizes}
    salt = F.element_at(F.create_map(*[F.lit(x) for b, s in salts.items() for x in (b, s)]), F.col("bucket"))
    vectors = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), salt).cast("int"))
    asked = settled(asked)
    seed, seen = [], 0
    for b, n, longest in sizes:  # the longest vectors, until there are some for every query
        if seed and seen > 4 * k:
            break
        seed.append((b, 1, longest))
        seen += n // salts[b]
    longest = vectors.filter("salt = 0").filter(F.col("bucket").isin([b for b, _, _ in seed]))
    first = settled(ranked(_met(asked.withColumn("least", F.lit(None).cast("long")), longest, seed, n_queries, k), k))
    level = first.groupBy("query_id", "own").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    asked = asked.join(level, ["query_id", "own"], "left")
    rest = [(b, salts[b], longest) for b, _, longest in sizes]
    searched = F.col("bucket").isin([b for b, _, _ in seed]) & (F.col("salt") == 0)
    found = _met(asked, vectors.filter(~searched), rest, n_queries, k)
    return ranked(found.unionByName(first.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(load(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


OP1_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT *, row_number() OVER () AS own FROM (SELECT DISTINCT * FROM whole WHERE vec_id % 50 = 0)),
scores AS (
  SELECT q.vec_id AS query_id, own, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM queries q JOIN whole p ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranks WHERE rank <= 5
"""
