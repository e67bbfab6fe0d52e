"""Readers for timetables, spreadsheets and feature collections.

Archives and workbooks are opened where Spark put their bytes; each file is a
row, so many feeds are read by many tasks.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Files a feed must and may have, and encodings in the order tried.
REQUIRED = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
OPTIONAL = ("calendar.txt", "calendar_dates.txt", "shapes.txt", "feed_info.txt")
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "shift_jis")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

ROWS = "path string, member string, row long, cells map<string,string>"


def decoded(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    for name in encodings:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding fits")


def _rows(files: DataFrame, opened) -> DataFrame:
    """Rows of ``opened(path, content)``: (member, row number, cells)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for member, n, cells in opened(path, content):
                    held.append({"path": path, "member": member, "row": n, "cells": list(cells.items())})
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(read, ROWS)


def _csv(member: str, raw: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    for n, row in enumerate(csv.DictReader(io.StringIO(decoded(raw)))):
        yield member, n, {k: v or "" for k, v in row.items() if k is not None and not isinstance(v, list)}


def zipped_feed(spark: SparkSession, path: str) -> DataFrame:
    """All cells of zipped feeds as text; members may lie in folders.  Raises if a required file is missing."""

    def opened(name: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = {m.rsplit("/", 1)[-1]: m for m in archive.namelist()}
            if missing := [r for r in REQUIRED if r not in members]:
                raise ValueError(f"{name}: missing {', '.join(missing)}")
            for base in (*REQUIRED, *OPTIONAL):
                if base in members:
                    yield from _csv(base, archive.read(members[base]))

    return _rows(spark.read.format("binaryFile").load(path), opened)


def feed_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder of text files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    base = F.element_at(F.split("path", "/"), -1)
    return _rows(files.filter(base.isin(*REQUIRED, *OPTIONAL)), lambda name, content: _csv(name.rsplit("/", 1)[-1], content))


def first_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV whose name comes first in each archive."""

    def opened(_: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            name = min(m for m in archive.namelist() if m.lower().endswith(".csv"))
            yield from _csv(name, archive.read(name))

    return _rows(spark.read.format("binaryFile").load(path), opened)


def feed_table(cells: DataFrame, member: str, *columns: str) -> DataFrame:
    """A projection of one file of a feed; what a row lacks is null."""
    return cells.filter(F.col("member") == member).select("row", *[F.col("cells")[c].alias(c) for c in columns])


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files in any of the known encodings."""
    return _rows(spark.read.format("binaryFile").load(path), lambda name, content: _csv(name.rsplit("/", 1)[-1], content))


def _sheets(content: bytes) -> Iterator[tuple[str, int, dict[int, str]]]:
    """Rows of every sheet that are not empty: the sheet, the number of the row, and its cells by column."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            for n, row in enumerate(ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")):
                found = {k: v for k, v in (_cell(c, shared) for c in row.iter(f"{_MAIN}c")) if v.strip()}
                if found:
                    yield sheet.get("name"), n, found


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every sheet (member) of workbooks, below each sheet's first row that is not empty."""

    def opened(_: str, content: bytes):
        header: dict[str, dict[int, str]] = {}
        for sheet, n, found in _sheets(content):
            if sheet not in header:
                header[sheet] = found
            else:
                yield sheet, n, {name: found.get(k, "") for k, name in header[sheet].items()}

    return _rows(spark.read.format("binaryFile").load(path), opened)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, row, cells): every row of every sheet that is not empty, its cells by number of the column."""
    rows = _rows(spark.read.format("binaryFile").load(path), lambda _, content: ((s, n, {str(k): v for k, v in found.items()}) for s, n, found in _sheets(content)))
    return rows.withColumn("cells", F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].cast("int").alias("key"), e["value"].alias("value")))))


def _cell(cell, shared: list[str]) -> tuple[int, str]:
    column = 0
    for letter in re.match(r"[A-Z]+", cell.get("r"))[0]:
        column = column * 26 + ord(letter) - 64
    if cell.get("t") == "inlineStr":
        return column, "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    text = "" if value is None else value.text or ""
    return column, shared[int(text)] if cell.get("t") == "s" and text else text


def features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of collections (plain or gzipped JSON), one row each; ``schema`` is that of their properties."""
    own = f"type string, features array<struct<id:string,properties:struct<{schema}>,geometry:struct<type:string,coordinates:array<double>>>>"
    return spark.read.schema(own).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.id", "f.properties", "f.geometry")


def overpass_ways(spark: SparkSession, path: str) -> DataFrame:
    """Elements of street map extracts, as the graph builders take them."""
    own = "elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    return spark.read.schema(own).option("multiLine", True).json(path).select(F.inline("elements"))
