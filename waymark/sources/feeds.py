"""Zipped feeds as a data source of Spark: planned by archive member, read as a stream, written from tables."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import ENCODINGS, OPTIONAL, REQUIRED, ROWS

#: Rows of a batch, and bytes that are decoded at once to find the encoding.
BATCH, STEP = 5000, 1 << 20
_SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Member(InputPartition):
    path: str
    inside: str
    name: str


def _encoding(archive: zipfile.ZipFile, inside: str) -> str:
    """The first encoding that fits the whole member, which passes by in steps."""
    for name in ENCODINGS:
        try:
            with archive.open(inside) as raw, io.TextIOWrapper(raw, name, newline="") as text:
                while text.read(STEP):
                    pass
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{inside}: no known encoding fits")


class FeedReader(DataSourceReader):
    def __init__(self, path: str, members: set[str], columns: set[str]):
        self.path, self.members, self.columns = path, members, columns

    def partitions(self) -> list[Member]:
        """A partition for each wanted member of each archive; of the archives only their lists of members are read."""
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.base_name.endswith(".zip")] if info.type == fs.FileType.Directory else [path]
        out = []
        for file in sorted(found):
            with system.open_input_file(file) as raw, zipfile.ZipFile(raw) as archive:
                inside = {m.rsplit("/", 1)[-1]: m for m in archive.namelist() if not m.endswith("/")}
            if missing := [r for r in REQUIRED if r not in inside]:
                raise ValueError(f"{file}: missing {', '.join(missing)}")
            out += [Member(file, inside[m], m) for m in (*REQUIRED, *OPTIONAL) if m in inside and (not self.members or m in self.members)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            encoding, held = _encoding(archive, partition.inside), []
            with archive.open(partition.inside) as inside, io.TextIOWrapper(inside, encoding, newline="") as text:
                for n, row in enumerate(csv.DictReader(text)):
                    cells = [(k, v or "") for k, v in row.items() if k is not None and not isinstance(v, list) and (not self.columns or k in self.columns)]
                    held.append({"path": partition.path, "member": partition.name, "row": n, "cells": cells})
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, _SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FeedWriter(DataSourceWriter):
    """Rows come sorted by feed, member and row; an archive is written as they pass."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        system, path = opened(self.path)
        system.create_dir(path)
        feed = member = archive = stream = out = None
        files: list[tuple[str, str]] = []

        def closed() -> None:
            if out is not None:
                out.close()
            if archive is not None:
                archive.close()
                stream.close()

        for row in rows:
            if row["feed"] != feed:
                closed()
                feed, member, out = row["feed"], None, None
                files.append((f"{path}/{uuid.uuid4().hex}.tmp", f"{path}/{feed}.zip"))
                stream = system.open_output_stream(files[-1][0], compression=None)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
            if row["member"] != member:
                if out is not None:
                    out.close()
                member = row["member"]
                out = archive.open(member, "w", force_zip64=True)
            out.write(row["line"].encode() + b"\n")
        closed()
        return Written(files)

    def commit(self, messages: list) -> None:
        """Only now do the archives get their names; those of failed or repeated tasks never do."""
        system, _ = opened(self.path)
        for temporary, name in (x for m in messages if m for x in m.files):
            system.move(temporary, name)

    def abort(self, messages: list) -> None:
        system, _ = opened(self.path)
        for temporary, _ in (x for m in messages if m for x in m.files):
            system.delete_file(temporary)


class FeedSource(DataSource):
    """Options: path, an archive or a folder of them; members and columns, by commas: what is not named is not decoded."""

    @classmethod
    def name(cls) -> str:
        return "zipped_feed"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FeedReader:
        of = lambda k: {x for x in self.options.get(k, "").split(",") if x}
        return FeedReader(self.options["path"], of("members"), of("columns"))

    def writer(self, schema, overwrite: bool) -> FeedWriter:
        return FeedWriter(self.options["path"])


def read_feeds(spark: SparkSession, path: str, members: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> DataFrame:
    """(path, member, row, cells): all cells of zipped feeds as text; of the named members and columns only, where there are names.  Raises if a required file is missing."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("zipped_feed").option("members", ",".join(members)).option("columns", ",".join(columns)).load(path)


def write_feeds(path: str, tables: dict[str, DataFrame]) -> None:
    """Writes an archive for each ``feed``: of each table, named by its member, the columns besides feed, in their order.

    An archive is one file, so one task writes it, row by row; feeds share out the work.
    """
    lines = None
    for member, table in tables.items():
        names = [c for c in table.columns if c != "feed"]
        cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        head = table.select("feed").distinct().select("feed", F.lit(member).alias("member"), F.lit(0).alias("row"), F.lit(",".join(names)).alias("line"))
        body = table.select("feed", F.lit(member).alias("member"), F.lit(1).alias("row"), F.concat_ws(",", *map(cell, names)).alias("line"))
        part = head.unionAll(body)
        lines = part if lines is None else lines.unionAll(part)
    spark = lines.sparkSession
    spark.dataSource.register(FeedSource)
    lines.repartition("feed").sortWithinPartitions("feed", "member", "row", "line").write.format("zipped_feed").mode("append").save(path)
