"""A corpus pipeline: language, near duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``, whatever further
columns there are and whatever their names.

Cases: null ids, languages and sources are values like others; null and empty
texts have no language and go in the first stage, except where there is no
language to learn, and stay in all others; repeated rows are copies of each
other, of which the second stage keeps one; very long texts are worked on
whole; an empty table passes through all stages as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import language_mix, ngram_join, secret_scan, sentencepiece_codec, source_mix
from waymark.llm.common import columns_of, discard, load, mark, settled

#: A document stays if its main language makes up this share of it at least.
LEAST_SHARE = 0.5


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter, and those without a main language.

    Where no document has a language to learn from, all stay.
    """
    model = language_mix.fit(docs.filter(~language_mix.held_out()))
    if not model.languages:
        return docs
    own = unused(docs, "language")
    found = language_mix.with_language(docs, model, out=own)
    kept = (F.col(f"{own}.lang_pred") != language_mix.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SHARE)
    return found.filter(kept).select(*columns_of(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, keeps that with the smallest id, and one row of it; those without a shingle all stay.

    Documents are told apart by id and text, as ids may be null or repeated.
    """
    found = settled(ngram_join.similar_documents(docs))
    own_id, own_key = unused(docs, "group_id"), unused(docs, "group_key")
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(own_id), ngram_join.text_key().alias(own_key))

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.toDF("key_id", "key_text")
        return rows.join(keys, rows[own_id].eqNullSafe(keys["key_id"]) & (rows[own_key] == keys["key_text"]), how)

    kept = matched(keyed, found.filter("not stays").select("doc_id", "text_key").distinct(), "left_anti")
    again = found.filter("stays and class is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if again.isEmpty():
        return kept.select(*columns_of(docs))
    repeated = matched(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    single = matched(kept, again, "left_anti")
    return single.unionByName(repeated).select(*columns_of(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces findings in texts; n_chars follows where there is one."""
    cleaned = secret_scan.redacted(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs)) if "n_chars" in docs.columns else cleaned


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that sources reach their targets."""
    mixed = source_mix.mix(docs.select("doc_id", "text", "source", F.struct(*columns_of(docs)).alias("row")))
    return source_mix.emitted(mixed).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids, of its decoded text and of its pieces' spans."""
    return sentencepiece_codec.with_digests(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "encoded.*")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("source_mix", mixed_sources),
    ("sentencepiece", encoded),
]

#: Fitted mixtures and piece encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder and read again.

    What a stage wrote on its way, and the result before, are deleted once its own result is written.
    """
    docs, since = load(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
            discard(spark, since)
    return docs
