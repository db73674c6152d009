from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, n long"

#: Nulls, empty and odd texts, ties and repeated rows, with further columns whose names the operators use themselves.
ODD = [
    (1, None, "en", "a", None, "k", "w", 1),
    (2, "", None, None, 0, None, None, None),
    (3, " \n\t ", "en", "a", 4, "k", "w", 1),
    (4, "One. Two, three! One.\nOne. Two, three! One.\n\n\x1f\n\x1f", "en", "b", 30, "k", "w", 1),
    (4, "One. Two, three! One.\nOne. Two, three! One.\n\n\x1f\n\x1f", "en", "b", 30, "k", "w", 1),
    (4, "same id, other text " * 12, "en", None, 30, "k", "w", 1),
    (None, "no id " * 30, "en", "b", 30, "k", "w", 1),
    (5, "Straße ÉCOLE naïve 日本語 <|endoftext|> <|EndOfText|> it's we'll é", "de", "c", 60, "k", "w", 1),
    (6, "lorem ipsum dolor sit amet " * 4000, "en", "b", 100_000, "k", "w", 1),
    (7, " ".join(f"w{i * 7919 % 5003}" for i in range(5000)), "en", "b", 30_000, "k", "w", 1),
    (8, "x" * 70_000, "en", "b", 70_000, "k", "w", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    """As a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
