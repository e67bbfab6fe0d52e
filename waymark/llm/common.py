"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator that counts or shingles words: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of texts that a function works on at once, at most.
TEXTS_AT_ONCE = 1000
#: Bytes of texts that a function takes apart at once, but for single longer ones.
BYTES_AT_ONCE = 8 << 20
#: Bounds on tables that are sent to every task.
MOST_SENT_ROWS, MOST_SENT_BYTES = 100_000, 16 << 20
#: A key of so many rows may be hot, and is dealt into parts of about so many; of such keys at most so many are dealt out.
HOT_ROWS, MOST_HOT = 1000, 10_000

_written: list[str] = []


def given_back() -> None:
    """Returns what was freed to the machine: a worker waits for its next task beside its executor, and within the same bound."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(function: Callable) -> Callable:
    """``function``, of batches or of a group, giving back what it has freed at its end."""

    @functools.wraps(function)
    def each(batches: Iterator) -> Iterator:
        yield from function(batches)
        given_back()

    @functools.wraps(function)
    def once(part):
        try:
            return function(part)
        finally:
            given_back()

    return each if inspect.isgeneratorfunction(function) else once


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column's name as one part, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster names.

    Where ``spark.checkpoint.dir`` is unset, a local session, whose only
    machine this is, takes a temporary folder; a cluster has to name one.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymark-"))
        base = sc.getCheckpointDir()
    _written.append(f"{base}/{uuid.uuid4().hex}")
    return _written[-1]


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts lineage, and survives the loss of any executor.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of folders written so far, for :func:`discard`."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the folders written since a mark, but for the last ``keep``; only for tables that no open plan reads."""
    gone = _written[since : len(_written) - keep]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since : since + len(gone)]


def sent_if_small(table: DataFrame) -> DataFrame:
    """A written table, to be sent to every task where it has ``MOST_SENT_ROWS`` rows and ``MOST_SENT_BYTES`` of strings at most; else joined as it is."""
    strings = [F.length(f.name) for f in table.schema.fields if f.dataType.simpleString() == "string"]
    rows, chars = table.agg(F.count("*"), F.sum(sum(strings, F.lit(0)))).first()
    return F.broadcast(table) if rows <= MOST_SENT_ROWS and (chars or 0) * 4 <= MOST_SENT_BYTES else table


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``TEXTS_AT_ONCE`` rows at most; Spark bounds the bytes of those it sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def in_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches whose strings in ``column`` have ``most`` bytes at most; a longer one makes a batch of its own."""
    for batch in in_parts(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = held = 0
        for k, size in enumerate(sizes):
            if k > at and held + size > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += size
        if at < len(sizes):
            yield batch.slice(at)


def looked_up(rows: DataFrame, found: DataFrame, key: str, spread: Column, counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """``rows`` joined with ``found``, one row a ``key``; the rows of a hot key are dealt by ``spread`` into parts of about ``HOT_ROWS``.

    Hot are keys of so many rows that few can be, so their list can be sent to
    every task.  ``counts`` (key, n) tells how many rows a key has, where that
    is known.
    """
    if counts is None:
        counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    counts = settled(counts.filter(F.col("n") >= HOT_ROWS))
    least = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = counts.filter(F.col("n") >= least).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    if hot.isEmpty():
        return rows.join(found, key, how)
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("salts")
    right = found.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")
