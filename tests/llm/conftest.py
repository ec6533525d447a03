import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, target string, kept string, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text, lang, source) as documents with further columns whose names clash with results."""

    def of(rows):
        full = [(i, t, g, s, len(t) if t is not None else None, 0.5, "x", "y", "z") for i, t, g, s in rows]
        return spark.createDataFrame(full, COLUMNS)

    return of


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, equal texts, repeated rows."""
    long_text = "alpha beta gamma delta " * 40_000
    return [
        (1, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "b"),
        (3, None, None, None), (4, "", "fr", "a"), (5, long_text, "de", "a"), (5, long_text, "de", "a"),
        (None, "no id here at all", "en", None), (6, "😀 naïve café x\n\tÉtude", "fr", "c"), (7, "A" * 5000, "en", "c"), (8, "   ", None, "c"),
    ]


@pytest.fixture(scope="session")
def edge(make, edge_rows):
    return make(edge_rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, by a fixed seed."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeioubdglmnrst") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
