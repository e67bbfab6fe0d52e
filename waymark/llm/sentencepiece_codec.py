"""SentencePiece encoding and decoding that keeps original byte spans.

Normalisation walks the model's compiled character map (a double-array trie)
by longest prefix and records, for every normalised byte, the original byte
it came from.  Pieces of the normalised text are then projected through that
alignment, so each piece names a span of the original UTF-8 text.

Cases: null text counts as empty; the empty text has no piece but the end id;
repeated rows each get their own result; very long runs without a space are
merged with a heap, in n log n; other columns of the input are untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments up to this length are merged by scanning and go together.
SHORT = 48
#: Bytes of text whose distinct segments are merged together; one text may be longer.
TOGETHER = 500_000
#: The rank of a pair that no piece joins.
NEVER = 2**30


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: uint32 trie size, trie, zero-ended outputs."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.outputs = blob[4 + size :]

    def prefix(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(output, bytes consumed) of the longest key that ``data`` holds at ``at``."""
        units, found = self.units, None
        node = self._step(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._step(node, unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        begin, used = found
        return self.outputs[begin : self.outputs.index(b"\0", begin)], used

    @staticmethod
    def _step(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Codec:
    """One BPE model: normalise, encode with spans, decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with white space as prefix are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.surface = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface.encode()
        for b, i in bytes_.items():
            self.surface[i] = bytes([b])
        # No piece joins text to a following space mark: then segments that begin with the marks merge apart.
        apart = self.escape and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if apart else lambda s: [s] if s else []
        self.id_text = list(map(str, range(len(model.pieces))))
        self._pairs()

    # -- normalisation -------------------------------------------------------
    def normalise(self, data: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original offset."""
        if self.map is None and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 32, 3, 1) if self.escape else np.ones(len(raw), np.int64)
            ahead = np.zeros((3 if self.escape else 1) * bool(self.dummy and data), np.int64)
            text = data.decode()
            text = text.replace(" ", SPACE) if self.escape else text
            align = np.concatenate([ahead, np.repeat(np.arange(len(raw)), wide), [len(raw)]])
            return (SPACE if self.escape else " ") * bool(len(ahead)) + text, align
        return self._rewrite(data)

    def _rewrite(self, data: bytes) -> tuple[str, np.ndarray]:
        mark = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def following(i: int) -> tuple[bytes, int]:
            found = self.map.prefix(data, i) if self.map else None
            if found:
                return found
            n = next((k for k in range(1, 4) if i + k >= len(data) or data[i + k] & 0xC0 != 0x80), 4)
            return data[i : i + n], n

        while self.squeeze and at < len(data):
            piece, used = following(at)
            if piece.strip(b" "):
                break
            at += used
        if at < len(data) and self.dummy:
            out += mark
            align += [at] * len(mark)
        after_space = self.squeeze
        while at < len(data):
            piece, used = following(at)
            piece = piece.lstrip(b" ") if after_space else piece
            if piece:
                written = piece.replace(b" ", mark)
                out += written
                align += [at] * len(written)
                after_space = self.squeeze and piece.endswith(b" ")
            at += used
        end = len(data)
        while self.squeeze and out.endswith(mark):
            del out[-len(mark) :]
            end = align[len(out)]
            del align[len(out) :]
        return out.decode("utf-8", "replace"), np.array([*align, end], np.int64)

    # -- merging -------------------------------------------------------------
    def _pairs(self) -> None:
        """Tables for merging many segments at once: symbols of characters, and the pairs that pieces join."""
        names = list(self.ids)
        self.base = len(names)  # from here on, a symbol is a character that is no piece
        number = {name: k for k, name in enumerate(names)}
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.base
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        number |= {c: self.base + ord(c) for p in names for c in p if c not in number}
        self.piece_id = np.array([self.ids[n] for n in names] or [0], np.int64)
        self.piece_size = np.array([len(n.encode()) for n in names] or [0], np.int64)
        pairs = {}
        for piece in names:
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = number[piece]
        self.symbol = number
        order = {score: k for k, score in enumerate(sorted({self.rank[n] for n in names}))}
        ranks = np.array([order[self.rank[n]] for n in names] or [0], np.int64)
        # An open hash table, eight slots a pair at least; pairs that meet a taken slot move on.
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_keys = np.full(1 << bits, -1, np.int64)
        self.pair_to = np.zeros(1 << bits, np.int64)
        self.pair_rank = np.full(1 << bits, NEVER, np.int64)
        left = np.array(list(pairs), np.int64)
        at = self._slot(left)
        while len(left):
            free = self.pair_keys[at] == -1
            self.pair_keys[at[free]] = left[free]
            over = self.pair_keys[at] != left
            left, at = left[over], (at[over] + 1) % len(self.pair_keys)
        taken = self.pair_keys >= 0
        self.pair_to[taken] = [pairs[k] for k in self.pair_keys[taken].tolist()]
        self.pair_rank[taken] = ranks[self.pair_to[taken]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined symbol) of pairs; rank NEVER where no piece joins them."""
        keys = left << 32 | right
        at = self._slot(keys)
        there = self.pair_keys[at]
        moved = np.flatnonzero((there != keys) & (there >= 0))
        while len(moved):
            at[moved] = (at[moved] + 1) % len(self.pair_keys)
            there = self.pair_keys[at[moved]]
            moved = moved[(there != keys[moved]) & (there >= 0)]
        return self.pair_rank[at], self.pair_to[at]

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all segments, one after another, and how many each has.

        Again and again the best pair of a segment is joined, the leftmost of
        equals.  Short segments advance together, one join each a round.
        """
        own = np.array([k for k, s in enumerate(segments) if len(s) <= SHORT], np.int64)
        ended_at, ended_with, ended_symbols = [], [], []
        for k, s in enumerate(segments):
            if len(s) > SHORT:
                parts = self._merge_long(s)
                ended_at.append([k])
                ended_with.append([len(parts)])
                ended_symbols.append([number if (number := self.symbol.get(p)) is not None else self.base + ord(p) for p in parts])
        char = np.frombuffer("".join([segments[k] for k in own.tolist()]).encode("utf-32-le"), np.uint32)
        symbol = self.of_char[char]
        size = np.array([len(segments[k]) for k in own.tolist()], np.int64)
        rank, to = self._look(symbol, np.append(symbol[1:], -1)[: len(symbol)])
        rank[np.cumsum(size) - 1] = NEVER
        while len(own):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), begin)
            ended = best >> 32 == NEVER
            if ended.any():
                gone = np.repeat(ended, size)
                ended_at.append(own[ended])
                ended_with.append(size[ended])
                ended_symbols.append(symbol[gone])
                symbol, rank, to = symbol[~gone], rank[~gone], to[~gone]
                own, size, begin, best = own[~ended], size[~ended], begin[~ended], best[~ended]
                if not len(own):
                    break
                at = (best & 0xFFFFFFFF) - begin
                begin = np.cumsum(size) - size
                at += begin
            else:
                at = best & 0xFFFFFFFF
            symbol[at] = to[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, rank, to = symbol[keep], rank[keep], to[keep]
            size, at = size - 1, at - np.arange(len(at))
            begin = np.cumsum(size) - size
            last = begin + size - 1
            rank[at[at >= last]] = NEVER
            changed = np.concatenate([at[at < last], at[at > begin] - 1])
            rank[changed], to[changed] = self._look(symbol[changed], symbol[changed + 1])
        if not ended_at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        which, counts = np.concatenate(ended_at).astype(np.int64), np.concatenate(ended_with).astype(np.int64)
        order = np.argsort(np.repeat(which, counts), kind="stable")
        return np.concatenate(ended_symbols).astype(np.int64)[order], counts[np.argsort(which)]

    def _merge_long(self, segment: str) -> list[str]:
        rank, parts, n = self.rank, list(segment), len(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + joined))
        return [p for p in parts if p]

    def _as_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the normalised bytes each covers, and the number of ids for each of ``counts``."""
        plain = symbols < self.base
        known = np.where(plain, symbols, 0)
        ids, sizes = np.where(plain, self.piece_id[known], self.unk), self.piece_size[known]
        if not plain.all():
            odd = symbols[~plain] - self.base
            wide = 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF)
            sizes[~plain] = wide
            if self.byte_ids is not None:  # each byte becomes an id of its own
                many = np.ones(len(symbols), np.int64)
                many[~plain] = wide
                word = np.repeat(np.arange(len(counts)), counts)
                counts = np.bincount(word, many, len(counts)).astype(np.int64)
                ids, sizes, plain = np.repeat(ids, many), np.repeat(sizes, many), np.repeat(plain, many)
                data = "".join(map(chr, odd.tolist())).encode()
                ids[~plain], sizes[~plain] = np.array(self.byte_ids)[np.frombuffer(data, np.uint8)], 1
        return ids, sizes, counts

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text ids, begins and ends; no end id yet.  Texts are taken some megabytes at a time."""
        start = 0
        while start < len(texts):
            stop, room = start, TOGETHER
            while stop < len(texts) and (stop == start or room >= len(texts[stop])):
                room -= len(texts[stop])
                stop += 1
            yield from self._encode_some(texts[start:stop])
            start = stop

    def _encode_some(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        normal = [self.normalise(t) for t in texts]
        split = [self.segments(text) for text, _ in normal]
        every = list(chain.from_iterable(split))
        distinct = dict.fromkeys(every)
        words = list(distinct)
        for k, word in enumerate(words):
            distinct[word] = k
        ids, sizes, counts = self._as_ids(*self.merge_all(words))
        first = np.cumsum(counts) - counts
        word = np.fromiter(map(distinct.__getitem__, every), np.int64, len(every))
        many = counts[word]
        upto = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(upto[-1]) + np.repeat(first[word] - upto[:-1], many)
        ids, sizes = ids[at].tolist(), sizes[at]
        done = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        for k, (_, align) in enumerate(normal):
            i, j = upto[done[k]], upto[done[k + 1]]
            edge = np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(np.int64)
            yield ids[i:j], align[edge[:-1]], align[edge[1:]]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        data = b"".join([self.surface[i] for i in ids])
        return data[1:] if self.dummy and data.startswith(b" ") else data


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def with_pieces(df: DataFrame, text: str = "text", out: str = "pieces", path: str | None = None) -> DataFrame:
    """``df`` with struct ``out``: ids, and each piece's begin and end byte in the original text.

    The end id stands last, with an empty span at the text's end.  A column
    named as ``out`` is replaced.
    """
    path = path or model_path()

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>")
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for part in parts:
            rows = []
            for data, (ids, begins, ends) in zip(part, own.encode_all(list(part)), strict=True):
                rows.append(([*ids, own.end], [*begins.tolist(), len(data)], [*ends.tolist(), len(data)]))
            yield pd.DataFrame(rows, columns=["ids", "begins", "ends"])

    return df.withColumn(out, pieces(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def with_text(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that the ids stand for; null ids count as none."""
    path = path or model_path()

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for part in parts:
            yield pd.Series([own.decode(list(x)) if x is not None else "" for x in part], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))


def with_digests(df: DataFrame, text: str = "text", out: str = "encoded", path: str | None = None) -> DataFrame:
    """``df`` with struct ``out``: number of ids, and digests of ids, decoded text and spans.

    What :func:`with_pieces` returns is hashed where it is made, so that no
    list of ids crosses to Spark.
    """
    path = path or model_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in parts:
            rows = []
            for ids, begins, ends in own.encode_all(list(part)):
                ids.append(own.end)
                spans = np.stack([begins, ends]).astype("<i8").tobytes()
                rows.append((len(ids), sha(" ".join([own.id_text[i] for i in ids]).encode()), sha(own.decode_bytes(ids)), sha(spans)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return df.withColumn(out, digests(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return with_digests(docs).select("doc_id", "encoded.*")
