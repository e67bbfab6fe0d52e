"""Exact join of documents whose sets of word n-grams overlap, and its components.

Candidates come from prefixes.  Under any one order of all shingles, two sets
that are similar enough share a shingle among the first few of each; so they
must do so under every one of several orders.  The first order's prefixes meet
in a Spark join on shingles.  Classes of the pairs that come of it get their
prefixes under all other orders, as narrow arrays; only pairs that share a
shingle under each order are joined with texts and verified.  All orders put frequent shingles last, each
breaks ties by a hash of its own.  Frequencies are counted over all documents:
a task sends its shingles as sorted, packed cells, and each range of cells is
counted in one place.  A bitmap keeps which cells several rows have; shingles of
other cells can meet nothing and are not sent to the join.  A full bitmap lets
more shingles through, and loses none.

Documents with equal sets form one class, and only classes are compared.  In a
group of classes that share a shingle, each is first compared with one hub;
then only those pairs are left to compare that are not connected yet, dealt by
size and block.  No link between components is lost, and large groups of near
copies stay linear.  Where all links are asked for (``linked_classes``,
``link_counts``), all pairs of a group are compared, in blocks; in large groups
of near copies they grow with the square, as the links do.

Shingles and classes are known by 64-bit hashes.

Cases: null, empty and blank texts have no shingle and link with nothing; a
text with fewer words than a shingle has one, its whole sequence; rows with a
null id take part, and never name a component unless all its ids are null;
repeated rows are classes of their own kind and get the same component; long
texts are compared whole; of ties for the row that stays, the smallest id and
then the smallest key of the text wins; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, given_back, in_parts, load, looked_up, mark, settled, tidied

#: Words of a shingle, and the least similarity in hundredths.
WORDS, LEAST = 5, 80
#: Shingles known as frequent, at most, and the count from which they are; others are ordered by hash alone.
FREQUENT, FREQUENT_FROM = 500_000, 16
#: Bits of the bitmap that tells which shingles several rows have, at most: 32 MB.
MOST_MARKS = 28
#: Shingles that a task sorts at once, and about so many that are counted in one place.
SORTED_AT, COUNTED_AT = 4_000_000, 8_000_000
#: Classes of a group in a block, where its pairs are compared.
BLOCK_ROWS = 1_000
#: Rows of three numbers that are sent to every task, at most: 24 MB.
MOST_SENT = 1_000_000
#: Orders that a candidate must pass besides the first.
FURTHER_ORDERS = 2

#: For each byte, whether it is white space.
_SPACE = bytes(b in (32, 9, 10, 11, 12, 13) for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
#: A number for each byte, equal for both cases of a letter, and one for each place in a shingle.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_PLACE = mixed(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    power = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, x, np.uint64))])
    return power(np.uint64(_STEP)), power(np.uint64(pow(_STEP, -1, 1 << 64)))


def placed_shingles(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a text's shingles in their order, equal ones as often as they occur; and the begin and end of each word.

    A word's hash is a difference of running sums over the bytes, so words of
    any length are hashed at once.
    """
    space = np.frombuffer(b" ".join((b"", data, b"")).translate(_SPACE), np.bool_)
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin, end
    up, down = _powers(max(17, (len(data) + 1).bit_length()))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    step = _BYTE[np.frombuffer(data, np.uint8)]
    step *= up[: len(data)]
    np.cumsum(step, out=total[1:])
    word = total[end]
    word -= total[begin]
    word *= down[begin]
    word = mixed(word)
    if len(word) < WORDS:
        return mixed(np.array([(word * _PLACE[: len(word)]).sum() + np.uint64(len(word))], np.uint64)), begin, end
    joined = word[: len(word) - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        joined += word[k : len(word) - WORDS + 1 + k] * _PLACE[k]
    return mixed(joined), begin, end


def distinct(found: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    found = np.sort(found)
    if len(found) < 2:
        return found
    fresh = found[1:] != found[:-1]
    return found if fresh.all() else found[np.append(True, fresh)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return distinct(placed_shingles((text or "").encode("utf-8", "replace"))[0])


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


class Orders:
    """Several orders of all shingles: by the class of frequency, then by a hash."""

    def __init__(self, cells: np.ndarray, levels: np.ndarray, bits: int, marks: np.ndarray | None = None):
        at = np.argsort(cells)
        self.cells, self.levels = np.append(cells[at], np.uint64(0)), np.append(levels[at], 0)
        self.shift, self.marks = np.uint64(64 - bits), np.full(1, 255, np.uint8) if marks is None else marks

    def shared(self, found: np.ndarray) -> np.ndarray:
        """False where no other row has the shingle; true where one has, and for some others."""
        at = found >> np.uint64(64 - 2 - len(self.marks).bit_length())
        return self.marks[at >> np.uint64(3)] >> (~at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def prefix(self, found: np.ndarray, k: int) -> np.ndarray:
        """The first shingles under order ``k``: so many that similar sets share one."""
        first = len(found) - -(-LEAST * len(found) // 100) + 1
        cell = found >> self.shift
        at = np.searchsorted(self.cells[:-1], cell)
        level = np.where(self.cells[at] == cell, self.levels[at], 0)
        key = found if k == 0 else mixed(found ^ np.uint64(k * _STEP & 0xFFFFFFFFFFFFFFFF))
        if level.any():
            return found[np.lexsort((key, level))[:first]]
        return found[:first] if k == 0 else found[np.argpartition(key, first - 1)[:first]]


class Lot:
    """Room for the shingles of many texts, which are sorted where they lie; nothing is held twice."""

    def __init__(self, most: int):
        self.room, self.size = np.empty(most, np.uint64), 0

    def add(self, found: np.ndarray) -> bool:
        """Whether there was room."""
        if self.size + len(found) > len(self.room):
            return False
        self.room[self.size : self.size + len(found)] = found
        self.size += len(found)
        return True

    def sorted(self) -> np.ndarray:
        """What was added; the room is free again once that is done with."""
        found, self.size = self.room[: self.size], 0
        found.sort()
        return found


def packed_cells(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps, their bytes of one place together, compressed."""
    gaps = np.diff(cells)
    most = int(gaps.max(initial=0))
    size = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = gaps.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return cells[:1].tobytes() + bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_cells(data: bytes) -> np.ndarray:
    size = data[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(size, -1)
    gaps = np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), gaps]), dtype=np.uint64)


def text_key() -> Column:
    """A 64-bit hash of the text: with doc_id it tells rows apart whose ids are equal or null."""
    return F.xxhash64("text").alias("text_key")


def members(docs: DataFrame) -> tuple[DataFrame, Orders]:
    """(doc_id, text_key, class, n) of each row, class null without shingles; and orders from counts over all rows."""
    # Words have about six characters; more ranges and wider cells for more of them.
    about = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6)
    ranges = max(32, 1 << math.ceil(math.log2(about / COUNTED_AT))) if about > COUNTED_AT else 32
    bits = min(56, max(32, about.bit_length() + 4))
    marks = 1 << max(ranges.bit_length() + 2, min(MOST_MARKS, max(16, about.bit_length() - 1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "class", "n", "range", "cells"]
        lot = Lot(SORTED_AT)

        def sent(found: np.ndarray) -> pa.RecordBatch:
            """Cells of sorted shingles, which are lost."""
            cells = np.right_shift(found, np.uint64(64 - bits), out=found)
            edges = np.searchsorted(cells, np.arange(1, ranges, dtype=np.uint64) << np.uint64(bits - ranges.bit_length() + 1))
            parts = [(k, packed_cells(part)) for k, part in enumerate(np.split(cells, edges)) if len(part)]
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k for k, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], names)

        for batch in in_parts(batches):
            classes, counts = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                counts.append(len(found))
                classes.append(class_of(found) if len(found) else None)
                if lot.add(found):
                    continue
                if lot.size:
                    yield sent(lot.sorted())
                if not lot.add(found):
                    yield sent(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(counts), pa.int64()), pa.nulls(len(counts), pa.binary())], names)
        if lot.size:
            yield sent(lot.sorted())

    def often(part: pa.Table) -> pa.Table:
        """Frequent cells of a range, and a row with the range and its part of the bitmap."""
        here = part.column("range")[0].as_py()
        cells = np.concatenate([unpacked_cells(x) for x in part.column("cells").to_pylist()])
        cells.sort()
        begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        met = np.diff(begin, append=len(cells))
        cells = cells[begin]
        del begin
        own = np.zeros(marks // ranges, bool)
        own[(cells[met > 1] >> np.uint64(bits - marks.bit_length() + 1)) % np.uint64(len(own))] = True
        keep = met >= FREQUENT_FROM
        frequent = pa.table({"cell": pa.array(cells[keep].view(np.int64)), "met": pa.array(met[keep].astype(np.int64)), "range": pa.nulls(keep.sum(), pa.int64()), "marks": pa.nulls(keep.sum(), pa.binary())})
        return pa.concat_tables([frequent, pa.Table.from_pylist([{"range": here, "marks": np.packbits(own).tobytes()}], frequent.schema)])

    rows = settled(docs.select(F.col("doc_id").cast("long"), "text", text_key()).mapInArrow(tidied(read), "doc_id long, text_key long, class long, n long, range long, cells binary"))
    counts = settled(rows.filter("cells is not null").select("range", "cells").groupBy("range").applyInArrow(tidied(often), "cell long, met long, range long, marks binary"))
    top = counts.filter("met is not null").orderBy(F.desc("met"), "cell").limit(FREQUENT).toArrow()
    found, size = np.zeros(marks // 8, np.uint8), marks // 8 // ranges
    for part in counts.filter("marks is not null").select("range", "marks").toLocalIterator():
        found[part["range"] * size : (part["range"] + 1) * size] = np.frombuffer(part["marks"], np.uint8)
    levels = np.log2(np.maximum(top.column("met").to_numpy(), 1)).astype(np.int64) if len(top) else np.empty(0, np.int64)
    return rows.filter("n is not null").select("doc_id", "text_key", "class", "n"), Orders(top.column("cell").to_numpy().astype(np.int64).view(np.uint64), levels, bits, found)


def _first_prefixes(docs: DataFrame, orders: Orders) -> DataFrame:
    """(token, place, class): what the first prefix of each class may share with others, once a task; the place is the position and the set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_parts(batches):
            tokens, places, classes = [], [], []
            for text in batch.column(0).to_pylist():
                found = shingles(text)
                if len(found) and (own := class_of(found)) not in seen:
                    seen.add(own)
                    first = shared.value.prefix(found, 0)
                    at = np.flatnonzero(shared.value.shared(first))
                    tokens.append(first[at])
                    places.append(at << 32 | len(found))
                    classes.append(np.full(len(at), own, np.int64))
            if tokens:
                arrays = [np.concatenate(tokens).view(np.int64), np.concatenate(places), np.concatenate(classes)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "place", "class"])

    return docs.select("text").mapInArrow(tidied(read), "token long, place long, class long")


def one_text_each(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, text) of the classes of ``pairs``; ``rows`` (doc_id, text_key, class) tells which rows have them."""
    # Tables of ids are written, so that Spark knows how small they are before it plans the next join.
    wanted = settled(pairs.select(F.explode(F.array("one", "other")).alias("class")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    first = rows.join(wanted, "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    first = settled(first.select("class", F.col("r.doc_id").alias("id"), F.col("r.text_key").alias("key")))
    own = docs.select(F.col("doc_id").cast("long"), "text", text_key())
    # Few candidates are sent to the texts; where there are many, texts are dealt by id and key.
    first = F.broadcast(first) if first.count() <= MOST_SENT else first
    return own.join(first, own["doc_id"].eqNullSafe(first["id"]) & (own["text_key"] == first["key"])).select("class", "text")


def shapes(docs: DataFrame, rows: DataFrame, orders: Orders, pairs: DataFrame) -> DataFrame:
    """(class, further_0, ..., packed) of the classes of ``pairs``: prefixes under the further orders as 32-bit hashes, and the compressed text."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        lists = lambda arrays: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays)))
        for batch in in_parts(batches):
            if not batch.num_rows:
                continue
            texts, further = [], [[] for _ in range(FURTHER_ORDERS)]
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                texts.append(press.compress(text.encode("utf-8", "replace")))
                for k in range(FURTHER_ORDERS):
                    further[k].append((shared.value.prefix(found, k + 1) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(lists, further), pa.array(texts, pa.binary())], ["class", *[f"further_{k}" for k in range(FURTHER_ORDERS)], "packed"])

    own = one_text_each(docs, rows, pairs)
    more = "".join(f"further_{k} array<int>, " for k in range(FURTHER_ORDERS))
    return settled(own.mapInArrow(tidied(read), f"class long, {more}packed binary").dropDuplicates(["class"]))


def groups(docs: DataFrame, orders: Orders) -> DataFrame:
    """(token, class, n, pos, hub, hub_n, hub_pos): the classes that share a shingle of their first prefixes, each with the group's hub.

    The hub is the class that has the shingle first; it has no row of its own.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token, place and class; only the group at hand is remembered."""
        token, hub, hub_place, last = None, 0, 0, 0
        for batch in batches:
            tokens, places, classes = (batch.column(k).to_numpy() for k in range(3))
            if not len(tokens):
                continue
            fresh = np.append(token is None or tokens[0] != token, tokens[1:] != tokens[:-1])
            again = ~fresh & (classes == np.append(last, classes[:-1]))
            own = np.maximum.accumulate(np.where(fresh, np.arange(len(tokens)), -1))
            hubs, hub_places = np.where(own < 0, hub, classes[own]), np.where(own < 0, hub_place, places[own])
            keep = ~fresh & ~again
            token, hub, hub_place, last = tokens[-1], hubs[-1], hub_places[-1], classes[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tokens, places, classes, hubs, hub_places)], ["token", "place", "class", "hub", "hub_place"])

    met = _first_prefixes(docs, orders).repartition("token").sortWithinPartitions("token", "place", "class").mapInArrow(tidied(grouped), "token long, place long, class long, hub long, hub_place long")
    size, pos = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftright(c, 32)
    return met.select("token", "class", size("place").alias("n"), pos("place").alias("pos"), "hub", size("hub_place").alias("hub_n"), pos("hub_place").alias("hub_pos"))


def _may_link(n: str, pos: str, m: str, other_pos: str) -> Column:
    """Sizes, and places of a shared shingle, that leave room for the least similarity."""
    n, m, left = F.col(n), F.col(m), F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other_pos))
    return (n * 100 >= m * LEAST) & (m * 100 >= n * LEAST) & (left * (100 + LEAST) >= (n + m) * LEAST)


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(one, other): each class of a group with its hub."""
    return shared.filter(_may_link("n", "pos", "hub_n", "hub_pos")).select(F.col("hub").alias("one"), F.col("class").alias("other")).distinct()


def _blocked(a: DataFrame, b: DataFrame, blocks: DataFrame) -> DataFrame:
    """Joins ``a`` and ``b`` (token, class, n, pos, ...) by token, band of size, and block of ``a``; sizes that may link lie in the same band or the next.

    ``blocks`` tells in how many blocks a token's rows of ``a`` are dealt; other tokens are left out.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / LEAST))).cast("int")
    left = a.join(blocks, "token").withColumns({"band": band, "block": F.pmod(F.xxhash64("class"), "blocks").cast("int")}).drop("blocks")
    right = b.join(blocks, "token").withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left.alias("a").join(right.alias("b"), ["token", "band", "block"]).filter(_may_link("a.n", "a.pos", "b.n", "b.pos"))


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK_ROWS).cast("int").alias("blocks")


def cross_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(one, other): the pairs of a group that are not connected yet.

    Classes outside the component of their group's hub meet all others of the
    group that are not in theirs; those within it need not meet each other, and
    none needs to meet the hub again.
    """
    own = looked_up(shared.select("token", "class", "n", "pos", "hub"), labels, "class", F.col("token")).withColumn("label", F.coalesce("label", "class"))
    hubs = labels.select(F.col("class").alias("hub"), F.col("label").alias("hub_label"))
    own = looked_up(own, hubs, "hub", F.col("class")).withColumn("minor", F.col("label") != F.coalesce("hub_label", "hub")).drop("hub", "hub_label")
    own = settled(own)
    counts = own.groupBy("token").agg(F.count("*").alias("all"), F.count(F.when(F.col("minor"), 1)).alias("minors"))
    blocks = settled(counts.filter("minors > 0 and all > 1").select("token", _blocks(F.col("minors"))))
    once = ~F.col("b.minor") | (F.col("a.class") < F.col("b.class"))
    met = _blocked(own.filter("minor").drop("minor"), own, blocks).filter((F.col("a.label") != F.col("b.label")) & once)
    return met.select(F.col("b.class").alias("one"), F.col("a.class").alias("other")).distinct()


def all_pairs(shared: DataFrame) -> DataFrame:
    """(one, other): all pairs of a group, once each."""
    hubs = shared.select("token", F.col("hub").alias("class"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos")).distinct()
    every = shared.select("token", "class", "n", "pos").unionByName(hubs)
    blocks = shared.groupBy("token").agg(_blocks(F.count("*") + 1))
    met = _blocked(every, every.toDF(*every.columns), blocks).filter(F.col("a.class") < F.col("b.class"))
    return met.select(F.col("a.class").alias("one"), F.col("b.class").alias("other")).distinct()


def _both(pairs: DataFrame, kept: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of the shapes of both."""
    for side in ("other", "one"):
        pairs = pairs.join(kept.select(F.col("class").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def filtered(pairs: DataFrame, kept: DataFrame, orders: int = FURTHER_ORDERS) -> DataFrame:
    """The pairs that share a shingle among the first ones under each of so many further orders as well."""
    names = [f"further_{k}" for k in range(orders)]
    met = _both(pairs, kept, *names)
    for name in names:
        met = met.filter(F.arrays_overlap(f"one_{name}", f"other_{name}"))
    return met.select("one", "other")


def verified(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        unpack = zstandard.ZstdDecompressor()

        @lru_cache(16)
        def whole(packed: bytes) -> np.ndarray:
            return shingles(unpack.decompress(packed).decode())

        def linked(a: bytes, b: bytes) -> bool:
            one, other = whole(a), whole(b)
            both = len(np.intersect1d(one, other, assume_unique=True))
            return 100 * both >= LEAST * (len(one) + len(other) - both)

        for a, b in parts:
            yield pd.Series([linked(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype=bool)
        whole.cache_clear()
        given_back()

    return _both(pairs, kept, "packed").filter(similar("one_packed", "other_packed")).select("one", "other")


def components(links: DataFrame) -> DataFrame:
    """(class, label): each linked class with the smallest class that links lead to.

    Large stars and small stars by turns, until no edge changes.
    """
    edges, before = settled(links.select(F.greatest("one", "other").alias("u"), F.least("one", "other").alias("v")).distinct()), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        edges = settled(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("class"), F.col("v").alias("label")).distinct())
        before = state


class Prepared:
    """Rows with their classes, orders, and groups of classes of ``docs``."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        self.rows, self.orders = members(self.docs)
        self.shared = settled(groups(self.docs, self.orders))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that pass every order and are similar enough."""
        since = mark()
        pairs = settled(pairs)
        kept = shapes(self.docs, self.rows, self.orders, pairs)
        found = settled(verified(settled(filtered(pairs, kept)), kept))
        discard(self.docs.sparkSession, since)
        return found

    def labels(self) -> DataFrame:
        """(class, label): each linked class with the smallest class that links lead to."""
        links = self.links(hub_pairs(self.shared))
        more = self.links(cross_pairs(self.shared, settled(components(links))))
        return settled(components(links.unionAll(more)))


def _all_links(own: Prepared) -> DataFrame:
    """(one, other, one_rows, other_rows): every two classes that are similar enough, and the rows of each."""
    sizes = own.rows.filter("class is not null").groupBy("class").agg(F.count("*").alias("rows"))
    links = own.links(all_pairs(own.shared))
    for side in ("one", "other"):
        links = links.join(sizes.select(F.col("class").alias(side), F.col("rows").alias(f"{side}_rows")), side)
    return links.select("one", "other", "one_rows", "other_rows")


def linked_classes(docs: DataFrame) -> DataFrame:
    """(one, other, one_rows, other_rows): every link between different classes of ``docs`` (doc_id, text)."""
    return _all_links(Prepared(docs))


def link_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, links): with how many other rows each row of ``docs`` (doc_id, text) is similar enough."""
    own = Prepared(docs)
    rows, links = own.rows, settled(_all_links(own))
    both = links.select(F.col("one").alias("class"), F.col("other_rows").alias("met")).unionAll(links.select(F.col("other").alias("class"), F.col("one_rows").alias("met")))
    met = both.groupBy("class").agg(F.sum("met").alias("met"))
    equal = rows.filter("class is not null").groupBy("class").agg((F.count("*") - 1).alias("equal"))
    counts = equal.join(met, "class", "left").select("class", (F.col("equal") + F.coalesce("met", F.lit(0))).alias("links"))
    found = looked_up(rows, counts, "class", F.struct("doc_id", "text_key"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class, n_shingles, component_id, stays) for each row of ``docs`` (doc_id, text).

    ``stays`` holds for the rows of one (doc_id, text) of each component: that with the smallest id, nulls last,
    then with the smallest key; and for rows without a shingle.
    """
    own = Prepared(docs)
    rows, labels = own.rows, own.labels()
    by_row = F.struct("doc_id", "text_key")
    placed = looked_up(rows, labels, "class", by_row).withColumn("label", F.coalesce("label", "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    lowest = placed.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("lowest"), first)
    stays = F.col("label").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    named = F.coalesce("lowest", "doc_id").alias("component_id")
    return looked_up(placed, lowest, "label", by_row).select("doc_id", "text_key", "class", F.col("n").alias("n_shingles"), named, stays.alias("stays"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(load(spark, sf_dir, "documents"))


_SETS_SQL = r"""words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS one, b.doc_id AS other FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*)))"""
OP7_SQL = f"""WITH RECURSIVE {_SETS_SQL},
reach AS (SELECT doc_id AS start, doc_id AS found FROM sets UNION SELECT start, other FROM reach JOIN links ON found = one)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets s JOIN (SELECT start, min(found) AS component_id FROM reach GROUP BY 1) ON start = s.doc_id
"""
OP7_LINKS_SQL = f"""WITH {_SETS_SQL}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(n, 0)::BIGINT AS links FROM sets s LEFT JOIN (SELECT one, count(*) AS n FROM links GROUP BY 1) ON one = s.doc_id
"""
