"""WARC archives as a Spark data source, for reading and writing.

Reading plans one partition for each group of files, takes predicates on
record headers from Spark, reads and decodes a record in small steps up to the
end of its headers, and leaves the payloads of records that they rule out, or
that nobody asks for, neither read nor decoded.  Spark offers predicates to a
Python source only where ``spark.sql.python.filterPushdown.enabled`` is set, and
then they are taken; ``where`` states them to the source in any session.

Each record is a gzip member of its own whose header names the member's
length (extra field ``sl`` of the WARC format's annex on compression), so the
reader can step over it.  Members without that field are read through.

Writing decides on ids and digests alone which records are revisits.  Where few
payloads are repeated, their digests are sent to every task, and no payload is
moved; where there are many, rows are dealt by id and digest, so that copies of
one payload do not meet.

Cases: null payloads count as empty, null ids and addresses leave their header
out and read back as null; equal rows become equal records; rows that share
the smallest id of their payload are all responses; a payload whose rows have
no id at all is stored by each of them; very long payloads are one record; an
empty table writes no record and reads back as an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import load, settled, shared_dir

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Columns that headers hold, so predicates on them need no payload.
HEADERS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")
#: Payloads below this many bytes are never replaced by a reference.
LEAST_SHARED = 100
#: A file is closed beyond this many bytes; a partition reads so many bytes of files, one file at least.
FILE_BYTES, PARTITION_BYTES = 256 << 20, 64 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes read and decoded at a time while a record's headers are looked for, and while its payload is wanted.
HEAD_STEP, BODY_STEP = 2048, 1 << 16
#: Repeated payloads whose digests are sent to every task, at most: some 100 bytes each.
MOST_SENT = 500_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member that names its compressed and plain length."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row) -> bytes:
    """A response with its payload, or a revisit that refers to one."""
    payload = bytes(row.payload or b"") if row.record_type != "revisit" else b""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{row.payload_digest}')}>"
    head = {
        "WARC-Type": row.record_type, "WARC-Record-ID": name(row.page_id), "WARC-Date": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": None if row.url is None else row.url.replace("\r", "%0D").replace("\n", "%0A"), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{row.payload_digest}",
        "X-Payload-Length": row.payload_bytes, "X-Page-ID": row.page_id, "X-Refers-To-Page-ID": row.refers_to,
        "WARC-Refers-To": None if row.refers_to is None else name(row.refers_to), "Content-Length": len(body),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + body + b"\r\n\r\n"


def parsed_head(head: bytes) -> dict:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        found[key.strip().lower()] = value.strip()
    number = lambda key: int(found[key]) if found.get(key) else None
    digest = found.get("warc-payload-digest")
    return {
        "page_id": number("x-page-id"), "url": found.get("warc-target-uri"), "record_type": found.get("warc-type"), "payload_bytes": number("x-payload-length"),
        "payload_digest": digest.rpartition(":")[2] if digest else None, "refers_to": number("x-refers-to-page-id"), "length": number("content-length") or 0,
    }


@dataclass
class Files(InputPartition):
    paths: list[str]


class Steps:
    """A file read in small steps; the last step is kept, so that what follows in it is not read again."""

    def __init__(self, file):
        self.file, self.at, self.held, self.bytes_read = file, 0, b"", 0

    def read(self, at: int, size: int) -> bytes:
        """At most ``size`` bytes from ``at`` on, as many as one step has; ``HEAD_STEP`` bytes are a step at least."""
        if not self.at <= at < self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(size, HEAD_STEP))
            self.bytes_read += len(self.held)
        return self.held[at - self.at : at - self.at + size]


class Unpacked:
    """One gzip member, read and decoded as far as asked."""

    def __init__(self, steps: Steps, start: int):
        self.steps, self.start, self.at, self.decode = steps, start, start, zlib.decompressobj(31)
        self.known, self.ready, self.decoded, self.left = None, bytearray(), 0, b""
        first = steps.read(start, 24)
        while len(first) < 24 and (more := steps.read(start + len(first), 24 - len(first))):
            first += more
        if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl":
            self.known = struct.unpack("<I", first[16:20])[0]

    def more(self, step: int) -> bool:
        """Decodes up to ``step`` further bytes; false at the member's end."""
        if self.decode.eof:
            return False
        data = self.left or self.steps.read(self.at, step)
        if not data:
            raise EOFError("a record ends too early")
        self.at += 0 if self.left else len(data)
        fresh = self.decode.decompress(data, step)
        self.left = self.decode.unconsumed_tail
        self.ready += fresh
        self.decoded += len(fresh)
        if self.decode.eof:
            self.known = self.known or self.at - len(self.decode.unused_data) - self.start
        return True

    def upto(self, mark: bytes) -> int:
        while (at := self.ready.find(mark)) < 0:
            if not self.more(HEAD_STEP):
                raise ValueError("a record has no end of headers")
        return at + len(mark)

    def rest(self) -> bytes:
        while self.more(BODY_STEP):
            pass
        return bytes(self.ready)

    def end(self) -> int:
        while self.known is None:
            self.more(BODY_STEP)
            self.ready.clear()
        return self.start + self.known


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, where: dict | None = None):
        self.path, self.payloads = path, payloads
        self.tests = [(key, [value]) for key, value in (where or {}).items()]
        self.bytes_read = self.bytes_decoded = 0

    def partitions(self) -> list[Files]:
        system, path = opened(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.is_file and x.base_name.endswith(".warc.gz")]
        groups, room = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not groups or room < x.size:
                groups.append(Files([]))
                room = PARTITION_BYTES
            groups[-1].paths.append(x.path)
            room -= x.size
        return groups or [Files([])]

    def wanted(self, head: dict) -> bool:
        return all(head[k] is not None if values is None else head[k] in values for k, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        system, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                at, size, steps = 0, file.size(), Steps(file)
                while at < size:
                    part = Unpacked(steps, at)
                    begin = part.upto(b"\r\n\r\n")
                    head = parsed_head(bytes(part.ready[:begin]))
                    if self.wanted(head):
                        payload = None
                        if self.payloads and head["record_type"] == "response":
                            body = part.rest()[begin : begin + head["length"]]
                            payload = body[body.index(b"\r\n\r\n") + 4 :]
                        head.pop("length")
                        rows.append(head | {"payload": payload})
                        held += len(payload or b"")
                    at = part.end()
                    self.bytes_decoded += part.decoded
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                self.bytes_read += steps.bytes_read
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class FilteringWarcReader(WarcReader):
    """Takes predicates from Spark too, for sessions that offer them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            held = isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if not held:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((f.attribute[0], None))
            else:
                self.tests.append((f.attribute[0], list(f.value) if isinstance(f, In) else [f.value]))


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, path = opened(self.path)
        system.create_dir(path)
        files, out, name = [], None, ""
        for row in rows:
            if out is None:
                name = f"{path}/part-{uuid.uuid4().hex}.warc.gz.tmp"
                out = system.open_output_stream(name, compression=None)
                files.append(name)
            out.write(member(record(row)))
            if out.tell() > FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """Only now do the files get names that readers see; files of failed or repeated tasks never do."""
        system, path = opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.base_name.endswith(".warc.gz"):
                    system.delete_file(x.path)
        for name in (n for m in messages if m for n in m.files):
            system.move(name, name.removesuffix(".tmp"))

    def abort(self, messages: list) -> None:
        system, _ = opened(self.path)
        for name in (n for m in messages if m for n in m.files):
            system.delete_file(name)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    """Options: path; payloads=false leaves every payload null and undecoded; where: a JSON object of header columns and the values they must have."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        kind = FilteringWarcReader if self.options.get("filters") == "true" else WarcReader
        return kind(self.options["path"], self.options.get("payloads", "true").lower() == "true", json.loads(self.options.get("where", "{}")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def archive_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most_sent: int = MOST_SENT) -> DataFrame:
    """The records that an archive of ``pages`` holds: each payload of some length once, then references to it."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    own = rows.select("page_id", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= LEAST_SHARED)
    repeated = settled(own.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if repeated.count() <= most_sent:
        placed = rows.join(F.broadcast(repeated), "payload_digest", "left")
    else:
        told = own.drop("payload_bytes").join(repeated, "payload_digest").filter(again).distinct()
        told = told.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first")
        placed = rows.join(told, rows["page_id"].eqNullSafe(told["_id"]) & (rows["payload_digest"] == told["_digest"]), "left")
    placed = placed.withColumn("again", again)
    return placed.select(
        "page_id", "url", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), "payload_bytes", "payload_digest",
        F.when(F.col("again"), F.col("first")).alias("refers_to"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def write_archives(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, **where) -> DataFrame:
    """Records whose header columns have the values of ``where``; without payloads if nobody asks for them."""
    spark.dataSource.register(WarcSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled").lower()
    return spark.read.format("warc").option("payloads", str(payloads).lower()).option("where", json.dumps(where)).option("filters", filters).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(archive_rows(load(spark, sf_dir, "pages")), path)
    responses = read_archives(spark, path, record_type="response")
    responses = responses.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    revisits = read_archives(spark, path, payloads=False, record_type="revisit")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
