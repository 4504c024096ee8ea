import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, k_id string, node string"


@pytest.fixture(scope="session")
def said():
    """said(rng, words): prose of invented words."""

    def make(rng: random.Random, words: int) -> str:
        parts = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(words)]
        return " ".join(parts)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows of (doc_id, text)): a table with extra columns whose names clash."""

    def make(rows):
        return spark.createDataFrame(
            [(key, text, "en", "s", 0, 0.5, 1, "x", "y") for key, text in rows], DOCS
        )

    return make


@pytest.fixture(scope="session")
def odd_rows(said):
    """Nulls, empty and long texts, blanks, repeated rows."""
    rng = random.Random(2)
    long = said(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "!!!"), (None, "a null id with some words in it"), (5, long), (6, "x"), (6, "x"), (7, "Été 日本 <|endoftext|>")]
