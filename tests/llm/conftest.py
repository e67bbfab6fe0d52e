import random

import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables and gives their folder; ``extra`` adds columns whose names clash with the operators'."""

    def write(extra: bool = False, **tables) -> str:
        for name, rows in tables.items():
            df = spark.createDataFrame(rows, SCHEMAS[name])
            if extra:
                for column in ("score", "size", "class", "n", "rank", "held_out", "target", "spans", "key", "payload_digest", "record_type", "language", "label"):
                    if column not in df.columns:
                        df = df.selectExpr("*", f"'x' AS {column}")
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, from a seed."""

    def make(seed: int, n: int, stems=("ta", "ri", "mon", "el", "ka", "su")) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture
def odd(prose):
    """Documents with nulls, empty, blank, long and repeated texts."""
    long_ = prose(5, 30_000)
    return [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, prose(1, 40), "en", "a", 1), (3, prose(1, 40), "en", "a", 1), (4, prose(1, 40), "en", "b", 1),
        (None, prose(1, 41), None, "b", 1), (5, long_, "en", "b", 1), (6, long_ + " end", "de", None, 1), (7, "x" * 50_000, None, "c", 1), (8, "日本語 ▁ ünï \x00 😀", "en", "c", 1), (9, "one two", "en", "c", 1), (10, "one  TWO", "en", "c", 1),
    ]
