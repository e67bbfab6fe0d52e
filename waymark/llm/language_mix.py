"""Language identification by inferring a document's mixture of languages.

A model holds, for each language, how likely each n-gram cell is.  For each
document expectation-maximisation estimates the languages' proportions; the
set of languages is grown while a likelihood penalised by the set's size
rises; the language with the largest proportion is the prediction.

Cases: null text, and text without a letter, is ``und`` with score 0; training
rows without text or language are passed over; where no row has a language,
every prediction is ``und``, as in an empty table; repeated rows get equal
results; of languages with equal proportions or likelihoods the first by name
is predicted; very long texts are counted into a fixed number of cells first;
other columns are untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, in_parts, load, tidied

UNKNOWN = "und"
#: N-grams are three bytes of lower-cased text, hashed to so many cells.
CELLS = 1 << 16
#: Languages that a task counts at once; with more, what it has is passed on first.
TABLES_AT_ONCE = 64
#: Added to each cell's count before likelihoods are taken.
SMOOTHING = 0.5
#: A further language must raise the log-likelihood by so much times log(n-grams).
PENALTY = 2.0
#: Rounds of expectation-maximisation at most, and the change at which it stops.
ROUNDS, STILL = 30, 1e-4

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII but letters becomes a space; bytes of other characters stay.
_PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def cells_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram cells that the text has, and their counts."""
    data = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    cell = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)
    if len(cell) > CELLS:
        count = np.bincount(cell, minlength=CELLS)
        cell = np.flatnonzero(count)
        return cell, count[cell]
    cell.sort()
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return cell[first].astype(np.int64), np.diff(np.append(first, len(cell)))


def expect(mixed, pull, n_languages: int, count: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of languages, by expectation-maximisation.

    ``mixed`` gives the cells' likelihoods under proportions, ``pull`` what
    weights of cells speak for each language.
    """
    n, share = count.sum(), np.full(n_languages, 1 / n_languages)
    for _ in range(ROUNDS):
        fresh = share * pull(count / mixed(share)) / n
        still = np.abs(fresh - share).max() < STILL
        share = fresh
        if still:
            break
    return share, float(count @ np.log(mixed(share)))


class LanguageModel:
    """Likelihoods of cells under languages, and the inference of mixtures.

    A language gives each cell that it never had the same likelihood, so only
    cells that it had are held, by cell: (language, likelihood beyond that of an
    unseen cell).  That is at most ``CELLS`` entries of 12 bytes for a language,
    whatever the number of rows learned from.
    """

    def __init__(self, languages: list[str], cell: np.ndarray, language: np.ndarray, n: np.ndarray):
        order = np.lexsort((language, cell))
        cell, language, n = cell[order], language[order], n[order].astype(float)
        total = np.bincount(language, n, len(languages)) + SMOOTHING * CELLS
        self.languages = languages
        self.unseen = SMOOTHING / total
        self.start = np.searchsorted(cell, np.arange(CELLS + 1))
        self.language = language.astype(np.int32)
        self.beyond = n / total[language]

    def entries(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the cells, language, likelihood beyond that of an unseen cell), of what the languages had of ``cell``."""
        size = self.start[cell + 1] - self.start[cell]
        which = np.repeat(np.arange(len(cell)), size)
        at = np.arange(len(which)) + np.repeat(self.start[cell] - np.append(0, np.cumsum(size)[:-1]), size)
        return which, self.language[at], self.beyond[at]

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, its proportion, proportions of the chosen set)."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, {}
        cell, count = cells_of(text)
        if not len(cell):
            return UNKNOWN, 0.0, {}
        m, many = len(cell), len(self.languages)
        which, language, beyond = self.entries(cell)
        alone = count.sum() * np.log(self.unseen) + np.bincount(language, count[which] * np.log1p(beyond / self.unseen[language]), many)
        chosen, share, best = [int(alone.argmax())], np.ones(1), float(alone.max())
        if many > 1:
            fine = PENALTY * np.log(count.sum())
            everything, _ = expect(
                lambda share: self.unseen @ share + np.bincount(which, beyond * share[language], m),
                lambda weight: self.unseen * weight.sum() + np.bincount(language, beyond * weight[which], many),
                many, count,
            )
            for k in np.argsort(-everything, kind="stable").tolist():
                if k in chosen:
                    continue
                some = [*chosen, k]
                likely, place = np.tile(self.unseen[some], (m, 1)), np.full(many, -1)
                place[some] = np.arange(len(some))
                held = place[language] >= 0
                likely[which[held], place[language[held]]] += beyond[held]
                wider, level = expect(likely.dot, lambda weight, likely=likely: weight @ likely, len(some), count)
                if level - fine <= best:
                    break
                chosen, share, best = some, wider, level - fine
        top = int(share.argmax())
        return self.languages[chosen[top]], float(share[top]), {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over every row of ``train``; what reaches the driver is a count for each cell that a language had."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for own, table in tables.items():
                cell = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(table[cell])], ["lang", "cell", "n"])
            tables.clear()

        for batch in in_parts(batches):
            for data, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own not in tables:
                    if len(tables) == TABLES_AT_ONCE:
                        yield from told()
                    tables[own] = np.zeros(CELLS, np.int64)
                cell, count = cells_of(data)
                tables[own][cell] += count
        yield from told()

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    sums = rows.mapInArrow(tidied(counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    own = sums.column("lang").combine_chunks().dictionary_encode()
    names = own.dictionary.to_pylist()
    languages = sorted(names)
    at = {x: k for k, x in enumerate(languages)}
    language = np.array([at[x] for x in names], np.int64)[own.indices.to_numpy()] if names else np.empty(0, np.int64)
    return LanguageModel(languages, sums.column("cell").to_numpy(), language, sums.column("n").to_numpy())


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with struct ``out``: lang_pred, score, and mixture (a map); a column so named is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def inferred(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([shared.value.infer(t) for t in part], columns=["lang_pred", "score", "mixture"])
        given_back()

    return df.withColumn(out, inferred(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op4_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    found = with_language(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")
