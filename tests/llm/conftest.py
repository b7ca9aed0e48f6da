from __future__ import annotations

import random

import pytest

from sluicebox.llm.common import prepare

#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = "id row node bucket hash key stats score label digest words ids found word_count".split()
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
TEXTS = [
    (10, "Plain text of a few words, and a few more."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "one"),
    (7, "Plain text of a few words, and a few more."), (7, "Plain text of a few words, and a few more."), (None, "Plain text of a few words, and a few more."),
    (8, "ünï cödé 漢字 \U0001f600 <|endoftext|> x"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and clashing extra columns."""
    prepare(spark)
    rows = [(i, t, *([0] * len(CLASHES))) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def draw():
    return random.Random(3)
