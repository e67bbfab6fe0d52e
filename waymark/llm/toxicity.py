"""Toxicity by compression distance.

One zstandard dictionary is trained on windows of ordinary text, one on windows
of toxic text, with the same trainer and settings.  Most of what the second one
holds is ordinary matter, and chance differences of that matter drown what is
toxic; so of the second only those stretches are kept that set toxic documents
apart, and they are laid over the first one's content.  Both compressors then
hold the same ordinary matter at the same distance.  A document is cut into
short windows; a window speaks for toxicity by the bytes that the toxic
dictionary saves.  How much, and in how many windows, passes thresholds that are
calibrated on labelled documents that the dictionaries have not seen.

The classifier is fitted on at most ``MOST_ROWS`` labelled documents of each
class and ``MOST_CHARS`` characters of them, those whose hashed ids come first;
of a long text the first ``MOST_CHARS / SHARE`` characters (64,000) are learned
from.  Everything else covers all rows, and whole texts are scored.

Cases: null text counts as empty, which has no window and the score of that;
labels that are null are passed over, several labels of one document count as
toxic if one is; if a class has no training row, as in an empty table, every
score is 0 (only ordinary rows or none) or 1 (only toxic rows); repeated rows
get equal scores, and ties of hashed ids go by id; very long texts are scored
window by window, whole; other columns are untouched, a column named as the
output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

#: Labelled documents of each class that a model is fitted on, at most.
MOST_ROWS = 4000
#: Characters of their texts, at most.
MOST_CHARS = 16_000_000
#: Of these characters one text may have this part.
SHARE = 250
#: Bytes of a window, cut at the next space; so a word is whole.
WINDOW = 64
#: Bytes of the content of the ordinary dictionary, and of the toxic one before it is thinned out.
ORDINARY_BYTES, TOXIC_BYTES = 6000, 60_000
#: Bytes of the samples that both are trained from.
SAMPLE_BYTES = 256
#: Characters of the beginnings of words that are looked at; words and beginnings that enter a dictionary, at most.
BEGINNINGS, PARTS = (4, 5, 6, 7), 400
#: A word or beginning in the toxic dictionary is kept if its share of toxic documents exceeds that of ordinary ones so many times, with a likelihood ratio statistic above so much.
RATIO, EVIDENCE = 4.0, 24.0
#: Gains, in bytes, that count windows.
GAINS = (2, 3, 4, 6)
LEVEL = 3
#: Weight decay of the calibration.
RIDGE = 3.0

_WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[bytes]:
    data, at, found = (text or "").lower().encode("utf-8", "replace"), 0, []
    while at < len(data):
        stop = min(len(data), at + WINDOW)
        if stop < len(data):
            space = data.find(b" ", stop, stop + WINDOW)
            stop = stop if space < 0 else space
        found.append(data[at:stop])
        at = stop
    return found


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of both dictionaries, and weights of a document's features; no weights: a constant."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.constant
        x = (np.array(features(self, text)) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.constant, -50, 50))))


@lru_cache(8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_BTOPT, min_match=3, write_content_size=False, write_dict_id=False)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=own)


def features(model: ToxicityModel, text: str | None) -> list[float]:
    """The largest gains of a window, the mean gain, and counts and shares of windows by gain."""
    plain, toxic = compressor(model.ordinary).compress, compressor(model.toxic).compress
    gain = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)
    if not len(gain):
        return [0.0] * (3 + 2 * len(GAINS))
    top = np.sort(gain)[::-1]
    return [top[0], top[1] if len(top) > 1 else 0.0, gain.mean(), *[np.log1p((gain >= g).sum()) for g in GAINS], *[(gain >= g).mean() for g in GAINS]]


def stretches(texts: list[str]) -> Counter[str]:
    """In how many texts each word stands, and each beginning of a word of ``BEGINNINGS`` characters."""
    found: Counter[str] = Counter()
    for text in texts:
        words = {f" {w} " for w in _WORD.findall(text.lower())}
        found.update(words | {w[: 1 + k] for w in words for k in BEGINNINGS if k < len(w) - 2})
    return found


def trained(texts: list[str], size: int) -> bytes:
    """The content of a dictionary trained on windows of ``texts``; too few of them to train on are the content."""
    samples = [d[i : i + SAMPLE_BYTES] for d in (t.lower().encode("utf-8", "replace") for t in texts) for i in range(0, len(d), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(size + 2048, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents for ordinary and toxic text.

    Of the dictionary trained on toxic text those words and beginnings of words
    are kept that ordinary documents have far less often; they follow the
    content of the dictionary trained on ordinary text, which the other one has
    at the same distance, so shared text compresses alike.
    """
    base, whole = trained(ordinary, ORDINARY_BYTES), trained(toxic, TOXIC_BYTES).decode("utf-8", "ignore")
    in_toxic, in_ordinary, n, m = stretches(toxic), stretches(ordinary), len(toxic), len(ordinary)
    telling = []
    for part in stretches([whole]):
        a, b = in_toxic[part], in_ordinary[part]
        if a * m <= RATIO * b * n:
            continue
        all_ = (a + b) / (n + m)
        evidence = 2 * (a * np.log(a / n / all_) + (b * np.log(b / m / all_) if b else 0))
        if evidence > EVIDENCE:
            telling.append((evidence, len(part), part))
    chosen: list[str] = []
    for _, _, part in sorted(telling, reverse=True):
        if len(chosen) < PARTS and not any(part in c or c.rstrip() in part for c in chosen):
            chosen.append(part)
    extra = "".join(reversed(chosen)).encode("utf-8", "replace")
    return base + bytes(len(extra)), base + extra


def fit_texts(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """A model from labelled texts: two thirds of a class for dictionaries, the rest for calibration."""
    by = {c: [t or "" for t, x in zip(texts, toxic, strict=True) if x == c] for c in (0, 1)}
    if min(map(len, by.values())) < 2:
        return ToxicityModel(b"", b"", (), (), (), float(len(by[1]) > len(by[0])))
    seen = {c: [t for k, t in enumerate(by[c]) if k % 3 < 2] for c in by}
    rest = {c: by[c][2::3] or by[c][-1:] for c in by}
    base, both = dictionaries(list(dict.fromkeys(seen[1])), list(dict.fromkeys(seen[0])))
    model = ToxicityModel(base, both, (), (), (), 0.0)
    x = np.array([features(model, t) for c in (0, 1) for t in rest[c]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.array([RIDGE] * x.shape[1] + [1e-6])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + ridge @ (w * w) / 2
    for _ in range(100):  # Newton's method for logistic regression, with steps that never go uphill
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        now, part = loss(w), 1.0
        while part > 1e-6 and loss(w + part * step) > now:
            part /= 2
        w = w + part * step
        if np.abs(part * step).max() < 1e-6:
            break
    return ToxicityModel(base, both, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> ToxicityModel:
    """A model from the rows of ``labels`` (doc_id, toxic) and their texts; of each class ``most`` with ``most_chars`` characters."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(most).unionAll(known.filter("toxic = 0").orderBy(*order).limit(most))
    # A long text is cut, so that it leaves room for others; what is sampled is bounded before it meets in one place.
    rows = docs.select("doc_id", F.left("text", F.lit(most_chars // SHARE)).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("x")).select("doc_id", "x.*")
    # A window over the sampled rows only.
    upto = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("toxic").orderBy(*order))
    got = rows.withColumn("upto", upto).filter(F.col("upto") <= most_chars).select("doc_id", "text", "toxic").orderBy(*order).toArrow()
    return fit_texts(got.column("text").to_pylist(), got.column("toxic").to_pylist())


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with column ``out``: how likely it is, from 0 to 1, that the text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shared.value.score(t) for t in part], dtype=float)

    return df.withColumn(out, scored(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").filter(~held_out()))
    scored = with_toxicity(docs.withColumn("held_out", held_out()), model, out="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
