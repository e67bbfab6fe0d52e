"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash of its bytes says so, each chunk is
compressed and stored once under its digest, and a payload is an ordered list
of digests.  Lists and store are written to the shared folder; reading joins
the lists to the store and verifies every payload.

Few bytes move.  The lists tell which digests come up again, a bitmap keeps
them, and chunks that it does not name are written where they are cut; only the
others meet by digest, so that each is stored once.  A full bitmap sends more of
them there, and changes nothing else.  A payload of a single chunk is read where
the store has it; only the chunks of longer payloads are sent on.

Cases: null text counts as empty and gives 64 zero bytes; repeated rows share
one list; a chunk that many payloads hold is stored once, and is sent to each
distinct payload only, lists that name it dealt into parts; very long texts are
cut like any other; an empty table gives an empty result; other columns are not
looked at, and ``keep`` names columns that must not be called n_bytes,
payload_digest or digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, load, looked_up, settled

#: Payloads are padded to a multiple of this.
BLOCK = 64
#: Bytes of a chunk: at least, about in the mean beyond that, at most.
SHORTEST, MEAN, LONGEST = 4096, 8192, 65536
LEVEL = 9
#: Bits of the bitmap of digests that come up again, at least and at most: 16 MB.
LEAST_MARKS, MOST_MARKS = 16, 27
#: Parts of the bitmap that are made apart from each other.
MARKED_PARTS = 64

#: A number for each byte value: splitmix64 of the byte.
_x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
_x = (_x ^ (_x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
GEAR = ((_x ^ (_x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash at a byte is the sum of GEAR of the last 32 bytes, each
    shifted left once for each byte since; doubling steps build it for all
    bytes at once.  A cut falls where its top bits are zero.
    """
    if len(data) <= SHORTEST:
        return [len(data)]
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        ahead = rolled[:-step] << np.uint32(step)
        rolled = rolled.copy()
        rolled[step:] += ahead
    bits = MEAN.bit_length() - 1
    marks = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1
    found, at = [], 0
    while len(data) - at > SHORTEST:
        k = np.searchsorted(marks, at + SHORTEST)
        at = min(int(marks[k]) if k < len(marks) else len(data), at + LONGEST, len(data))
        found.append(at)
    if at < len(data):
        found.append(len(data))
    return found


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (BLOCK if not data else 0))


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def recipes(media: DataFrame, payload: str | Column, *keep: str) -> DataFrame:
    """``keep``, and n_bytes, payload_digest and chunk digests of each row's padded payload."""

    @F.pandas_udf("n_bytes long, payload_digest binary, digests array<binary>")
    def described(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for data in part:
                full = padded(data)
                digests = [hashlib.sha256(c).digest() for c in chunks(full)]
                rows.append((len(data), hashlib.sha256(full).digest(), digests))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_digest", "digests"])

    column = F.col(payload) if isinstance(payload, str) else payload
    return media.select(*keep, described(F.coalesce(column.cast("binary"), F.lit(b""))).alias("_r")).select(*keep, "_r.*")


def _place(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4], "big") >> (32 - bits)


def again(lists: DataFrame) -> np.ndarray:
    """A bitmap of the digests that come up more than once in ``lists``, by their first bits."""
    n = lists.agg(F.sum(F.size("digests"))).first()[0] or 0
    bits = min(MOST_MARKS, max(LEAST_MARKS, (16 * n).bit_length()))
    size = (1 << bits) // MARKED_PARTS

    def marked(part: pa.Table) -> pa.Table:
        own = np.zeros(size, bool)
        own[part.column("place").to_numpy() % size] = True
        return pa.table({"part": part.column("part")[:1], "marks": pa.array([np.packbits(own).tobytes()], pa.binary())})

    place = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits)
    met = lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    places = met.select(place.alias("place")).distinct().withColumn("part", F.floor(F.col("place") / size))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for part in places.groupBy("part").applyInArrow(marked, "part long, marks binary").toLocalIterator():
        found[part["part"] * size // 8 : (part["part"] + 1) * size // 8] = np.frombuffer(part["marks"], np.uint8)
    return found


def store(media: DataFrame, payload: str | Column, marks: np.ndarray | None = None) -> DataFrame:
    """Each distinct chunk once: digest, its compressed bytes, and whether it is a payload of its own and a part of a longer one.

    ``marks`` is the bitmap of :func:`again` for the same payloads; without it all chunks meet by digest.
    """
    column = F.col(payload) if isinstance(payload, str) else payload
    payloads = media.select(F.coalesce(column.cast("binary"), F.lit(b"")).alias("payload"))
    shared = media.sparkSession.sparkContext.broadcast(marks)
    bits = 0 if marks is None else len(marks).bit_length() + 2

    def stored(repeated: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press, marks = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), shared.value
            for batch in in_parts(batches):
                frames: dict[bytes, list] = {}
                for data in batch.column(0).to_pylist():
                    parts = chunks(padded(data))
                    for chunk in parts:
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in frames:
                            at = 0 if marks is None else _place(digest, bits)
                            if (marks is None or bool(marks[at >> 3] >> (7 - (at & 7)) & 1)) != repeated:
                                continue
                            frames[digest] = [press.compress(chunk), False, False]
                        frames[digest][1 + (len(parts) > 1)] = True
                columns = zip(*frames.values(), strict=True) if frames else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((frames, *columns), (pa.binary(), pa.binary(), pa.bool_(), pa.bool_()), strict=True)], ["digest", "frame", "whole", "part"])

        return payloads.mapInArrow(cut, "digest binary, frame binary, whole boolean, part boolean")

    met = stored(True).groupBy("digest").agg(F.first("frame").alias("frame"), F.max("whole").alias("whole"), F.max("part").alias("part"))
    return met if marks is None else stored(False).unionByName(met)


def read_back(lists: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """For each distinct (payload_digest, digests) of ``lists`` its payload_digest, frames in order, and n_chunks.

    A payload of a single chunk is complete where the chunk is; only the
    chunks of longer payloads are sent on.
    """
    parts = lists.select("payload_digest", "digests").dropDuplicates(["payload_digest"]).select("payload_digest", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("pos", "digest"))
    joined = looked_up(parts, chunk_store.select("digest", "frame"), "digest", F.col("payload_digest"))
    single = joined.filter("n_chunks = 1").select("payload_digest", F.array("frame").alias("frames"))
    longer = joined.filter("n_chunks > 1").groupBy("payload_digest").agg(F.sort_array(F.collect_list(F.struct("pos", "frame"))).alias("x"))
    return single.unionByName(longer.select("payload_digest", F.col("x.frame").alias("frames")))


def with_features(read: DataFrame) -> DataFrame:
    """What the stored frames hold, decoded and verified: raises if a payload is not what was stored."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def described(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for digests, lists in parts:
            rows = []
            for digest, frames in zip(digests, lists, strict=True):
                if any(x is None for x in frames):
                    raise ValueError(f"payload {digest.hex()} has a chunk that is not in the store")
                data, media = b"".join(map(unpack.decompress, frames)), b"".join(frames)
                found = hashlib.sha256(data)
                if found.digest() != digest:
                    raise ValueError(f"payload {digest.hex()} was read back as {found.hexdigest()}")
                level = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
                bits = float(-(level[level > 0] * np.log2(level[level > 0])).sum())
                rows.append((len(data), found.hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"chunks={len(frames)};bits={bits:.4f}"))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read.select("payload_digest", described("payload_digest", "frames").alias("_f")).select("payload_digest", "_f.*")


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lists = settled(recipes(docs, "text", "doc_id"))
    chunk_store = settled(store(docs, "text", again(lists)))
    # The digest of a payload of one chunk is that of the chunk.
    single = with_features(chunk_store.filter("whole").select(F.col("digest").alias("payload_digest"), F.array("frame").alias("frames")))
    longer = with_features(read_back(lists.filter(F.size("digests") > 1), chunk_store.filter("part")))
    found = looked_up(lists.select("doc_id", "n_bytes", "payload_digest"), single.unionByName(longer), "payload_digest", F.col("doc_id"))
    lost = F.raise_error(F.concat(F.lit("payload "), F.lower(F.hex("payload_digest")), F.lit(" has a chunk that is not in the store")))
    return found.withColumn("payload_sha256", F.when(F.col("payload_sha256").isNull(), lost).otherwise(F.col("payload_sha256"))).drop("payload_digest")


def op5_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`op5_media_chunks` that SQL can tell."""
    return op5_media_chunks(spark, sf_dir).drop("media_bytes", "media_sha256", "feature")


OP5_PAYLOADS_SQL = """
WITH sizes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
padded AS (SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64)::BIGINT AS size, h || repeat('00', (greatest(64, (n + 63) // 64 * 64) - n)::INT) AS h FROM sizes),
tails AS (SELECT *, list_transform(range(0, 64), lambda i: ('0x' || substr(h, (length(h) - 127 + 2 * i)::INT, 2))::BIGINT) AS tail FROM padded)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(list_reduce(tail, lambda c, b: list_reduce(list_transform(range(0, 8), lambda k: 0::BIGINT), lambda s, z: xor(s >> 1, 3988292384::BIGINT * (s & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS tail_crc32 FROM tails
"""
