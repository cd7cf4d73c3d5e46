"""Rows that every operator of texts has to bear."""

import pytest

AWKWARD = [
    (1, "the cat sat on the mat and the dog ran to a house"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "word"),
    (6, "the cat sat on the mat and the dog ran to a house"),  # a copy
    (6, "the cat sat on the mat and the dog ran to a house"),  # a repeated row
    (None, "a row without an id and the rest of it"),
    (7, "Grüße aus Köln 🚀 ▁ Ωmega a\x00b 日本語"),
    (8, "x" * 30_000),
    (9, " ".join(f"w{i}" for i in range(4_000))),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, copies and repeated rows."""
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
