"""Document fingerprints by MinHash, and the classes of near copies.

A text is a set of hashed word shingles.  Each of many universal hash functions
x -> a * x + b mod 2**64, a odd, orders that set anew, all of them at once in
numpy; the least values are the signature.  The fingerprint keeps a byte of
each (b-bit minwise hashing); the share of equal bytes, less what chance gives,
estimates the Jaccard similarity.  A text and its edited form have most words in
common: the signature of what both have is made once, and the lesser values of
it and of the rest are those of either.

Near copies: texts with equal sets are one class; classes of which enough
shingles are the same are linked, and linked classes form components.  A
signature can miss a link, whatever its length, so links are those of the exact
join of ``ngram_join``, none of which is lost.

Texts next to each other by id come together by a range partitioning on id, text
and place, sent compressed; only the edges of partitions need a second look.

Cases: null text counts as empty; texts without words have no shingle, one and
the same fingerprint, and no near copies; a text with fewer words than a
shingle has one, its whole sequence; rows with a null id come first; rows with
equal ids follow each other by a hash of the text, equal rows stand side by
side; a single row is its own next; very long texts are read whole; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_bytes, load, looked_up, mark, settled, tidied
from .ngram_join import WORDS, Prepared, class_of, distinct, mixed, placed_shingles, text_key

#: Values of a signature.
PERMUTATIONS = 120
#: Shingles that all functions are applied to at once: half a megabyte of products.
AT_ONCE = 512
#: Bytes of compressed texts that a task sorts, about.
TASK_BYTES = 32 << 20

_FACTOR = (mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
_SHIFT = mixed(np.arange(5001, 5001 + PERMUTATIONS, dtype=np.uint64))[:, None]
_UNPACK = zstandard.ZstdDecompressor()


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each function over the hashed shingles; all ones where there are none."""
    least = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    room = np.empty((PERMUTATIONS, min(AT_ONCE, len(found))), np.uint64)
    for at in range(0, len(found), AT_ONCE):
        part = found[None, at : at + AT_ONCE]
        values = np.multiply(_FACTOR, part, out=room[:, : part.shape[1]])
        np.minimum(least, np.add(values, _SHIFT, out=values).min(axis=1), out=least)
    return least


def fingerprint(least: np.ndarray) -> bytes:
    """A byte of each value of the signature."""
    return mixed(least).astype(np.uint8).tobytes()


def likeness(one: bytes, other: bytes) -> float:
    """The similarity that two fingerprints tell: 1 if they are equal, about 0 for unlike sets."""
    same = np.count_nonzero(np.frombuffer(one, np.uint8) == np.frombuffer(other, np.uint8)) / len(one)
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many from the start of the one that follows."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


class _Row:
    """A row of the sorted table, with what its text gives."""

    def __init__(self, doc_id, text_key: int, packed: bytes):
        self.doc_id, self.text_key, self.packed = doc_id, text_key, packed
        data = _UNPACK.decompress(packed)
        self.text = data.decode()
        found, begin, end = placed_shingles(data)
        self.label = class_of(distinct(found)) if len(found) else None
        # Words that end before the last quarter stay when it is replaced, and so do the shingles of such words alone.
        left = len(edited(self.text, "").encode())
        alone = max(0, int(np.searchsorted(end, left)) - WORDS + 1)
        #: The signature of shingles that stay; the byte where those begin that may not.
        self.stays, self.at, self.alone = signature(found[:alone]), int(begin[alone]) if alone else 0, alone
        self.fingerprint = fingerprint(np.minimum(self.stays, signature(found[alone:])))

    def edited_fingerprint(self, changed: bytes) -> bytes:
        """The fingerprint of the text as edited."""
        rest, begin, _ = placed_shingles(changed[self.at :])
        # After shingles that stay, too few words for one add nothing.
        return fingerprint(self.stays if self.alone and len(begin) < WORDS else np.minimum(self.stays, signature(rest)))

    def told(self, following: _Row | None = None) -> dict:
        """The columns of the row; those of the comparison where the next row is known."""
        out = {"doc_id": self.doc_id, "text_key": self.text_key, "n_chars": len(self.text), "fingerprint": self.fingerprint, "class": self.label}
        if following is not None:
            changed = edited(self.text, following.text)
            data = changed.encode()
            own = self.fingerprint if changed == self.text else self.edited_fingerprint(data)
            out |= {"edited_sha256": hashlib.sha256(data).digest(), "edited_fingerprint": own, "near_edited": likeness(self.fingerprint, own), "near_next": likeness(self.fingerprint, following.fingerprint)}
        return out


_COLUMNS = "text_key long, n_chars long, fingerprint binary, class long, edited_sha256 binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGES = "first int, last int, packed binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[dict], doc_id: pa.DataType, columns: str) -> pa.RecordBatch:
    fields = [pa.field("doc_id", doc_id)] + [pa.field(name, _ARROW[kind]) for name, kind in map(str.split, columns.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def described(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, text_key, n_chars, fingerprint, class, and the comparison with the next row.

    The next row is that with the next id; after the last comes the first.
    The class is null where there are no words.
    """
    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(), F.monotonically_increasing_id().alias("place"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in in_bytes(batches, 1):
            texts = [press.compress(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], ["doc_id", "packed", "text_key", "place"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is told once the next one is known; the ends of a partition carry its number and their texts."""
        here, held, edge, kind = TaskContext.get().partitionId(), None, {}, None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for row in map(_Row, *[batch.column(k).to_pylist() for k in range(3)]):
                if held is None:
                    edge = {"first": here, "packed": row.packed}
                else:
                    out.append(held.told(row) | edge)
                    edge = {}
                held = row
            yield _batch(out, kind, f"{_COLUMNS}, {_EDGES}")
        if held is not None:
            yield _batch([held.told() | edge | {"last": here, "packed": held.packed}], kind, f"{_COLUMNS}, {_EDGES}")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lasts, nexts = map(_Row, *[batch.column(k).to_pylist() for k in range(3)]), map(_Row, *[batch.column(k).to_pylist() for k in (0, 1, 3)])
            yield _batch([a.told(b) for a, b in zip(lasts, nexts, strict=True)], batch.column(0).type, _COLUMNS)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    dealt = rows.mapInArrow(tidied(packed), f"{doc_id}, packed binary, text_key long, place long").select("doc_id", "text_key", "packed", "place")
    dealt = dealt.repartitionByRange(parts, "doc_id", "text_key", "place").sortWithinPartitions("doc_id", "text_key", "place")
    found = settled(dealt.mapInArrow(tidied(read), f"{doc_id}, {_COLUMNS}, {_EDGES}"))

    # The last row of a partition meets the first of the next that has rows: a row for each partition.
    lasts = found.filter("last is not null").select("doc_id", "text_key", "packed", "last")
    following = F.coalesce(F.lead("last").over(Window.orderBy("last")), F.min("last").over(Window.partitionBy()))
    following = lasts.select("last").select("last", following.alias("first"))
    nexts = found.filter("first is not null").select("first", F.col("packed").alias("next_packed"))
    ends = lasts.join(following, "last").join(nexts, "first").select("doc_id", "text_key", "packed", "next_packed").mapInArrow(closed, f"{doc_id}, {_COLUMNS}")
    return found.filter("last is null").drop("first", "last", "packed").unionByName(ends)


def near_copies(docs: DataFrame) -> DataFrame:
    """(class, label): each class of ``docs`` (doc_id, text) that is linked with others, with the smallest class that links lead to."""
    since = mark()
    labels = Prepared(docs).labels()
    discard(docs.sparkSession, since)
    return labels


def with_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of :func:`described` with class_id: the smallest id among the near copies that links lead to, its own included."""
    least = settled(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    placed = least.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = placed.groupBy("label").agg(F.min("first").alias("class_id"))
    named = settled(placed.join(lowest, "label").filter("n > 1 or not (class_id <=> first)").select("class", "class_id"))
    found = looked_up(rows, named, "class", F.struct("doc_id", "text_key"), least.select("class", "n"))
    return found.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = near_copies(docs)
    found = with_classes(described(docs), labels)
    digits = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", *digits, "near_edited", "near_next", "class_id")
