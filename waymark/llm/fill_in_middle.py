"""Fill-in-the-middle: texts cut at two units and put together in another order.

A unit is a word with the white space before it, or white space at the end.
The whole batch is one pipeline of pyarrow.compute: the gaps and the words of
all texts are split into list arrays, flattened with their parents, joined to
units, numbered within their text, filtered by role, rebuilt as lists of
prefix, middle and suffix, and joined to pieces and outputs.  The cuts and the
form of a text follow from a digest of the seed and its id alone, so they do
not depend on partitions.

Cases: null text counts as empty; empty texts, and texts that hold a mark of
the format, stay plain; null ids are hashed as an empty string; rows with equal
ids are cut by the same numbers, each at its own units; very long texts make a
batch of their own and are cut whole; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_bytes, load

SEED = 42
#: In hundredths: texts that are cut, and of those, texts with the suffix first.
CUT, SUFFIX_FIRST = 50, 80
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A mark; no piece of a text without one can make a new one where pieces meet.
MARK = "<[PSM]>"
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def _mod(x: pa.Array, y: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, y), y))


def _numbers(n: int) -> pa.Array:
    return pa.array(range(n), pa.int64())


def _offsets(sizes: pa.Array) -> pa.Array:
    """Where each of the lists of these sizes begins, and where the last ends."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])


def _sizes(lists: pa.ListArray) -> pa.Array:
    return pc.cast(pc.list_value_length(lists), pa.int64())


def units(texts: pa.StringArray) -> pa.ListArray:
    """The units of each text, in order; together they are the text."""
    gaps, split = pc.split_pattern_regex(texts, _WORD), pc.split_pattern_regex(texts, _SPACE)
    words = pc.list_flatten(split)
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    # Before each word is a gap, and behind the last one more: the n-th gap of all, but for those last ones, precedes the n-th word of all.
    parent, sizes = pc.cast(pc.list_parent_indices(gaps), pa.int64()), _sizes(gaps)
    number = _numbers(len(parent))
    last = pc.equal(pc.add(number, 1), pc.take(_offsets(sizes), pc.add(parent, 1)))
    word = pc.if_else(last, pa.scalar(None, pa.int64()), pc.subtract(number, parent))
    found = pc.binary_join_element_wise(pc.list_flatten(gaps), pc.fill_null(pc.take(words, word), ""), "")
    some = pc.greater(pc.binary_length(found), 0)
    at_end = pc.cast(some.filter(last), pa.int64())
    return pa.ListArray.from_arrays(pc.cast(_offsets(pc.add(pc.subtract(sizes, 1), at_end)), pa.int32()), found.filter(some))


def cut(texts: pa.StringArray, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The number of units of each text, and its prefix, middle and suffix: cut after h1 and h2, each modulo one more than the units."""
    lists = units(texts)
    n = _sizes(lists)
    a, b = _mod(h1, pc.add(n, 1)), _mod(h2, pc.add(n, 1))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    flat, parent = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    ordinal = pc.subtract(_numbers(len(flat)), pc.take(_offsets(n), parent))
    before, within = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    roles = ((before, low), (pc.and_not(within, before), pc.subtract(high, low)), (pc.invert(within), pc.subtract(n, high)))
    return n, *[pc.binary_join(pa.ListArray.from_arrays(pc.cast(_offsets(size), pa.int32()), flat.filter(mask)), "") for mask, size in roles]


def _hashes(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def filled_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text); form is plain, spm or psm."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_bytes(batches, 1):
            doc_id, texts, h1, h2, h3, h4 = batch.columns
            n, prefix, middle, suffix = cut(texts, h1, h2)
            plain = pc.or_(pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, MARK)), pc.greater_equal(_mod(h3, 100), CUT))
            form = pc.if_else(plain, "plain", pc.if_else(pc.less(_mod(h4, 100), SUFFIX_FIRST), "spm", "psm"))
            spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([doc_id, n, form, *chars, output], names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_hashes(F.col("doc_id"), seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    piece = F.split(output, MARK, -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(F.concat(piece[1], piece[3], piece[2]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filled_in_middle(load(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cuts AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(0, 4)] AS h FROM hashed),
placed AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cuts),
pieces AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 :], ''), '') AS s FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM pieces
"""
