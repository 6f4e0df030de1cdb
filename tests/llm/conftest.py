import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string, fp string, score string, row int, h double, digest string, kept string, root string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use inside."""

    def make(rows):
        full = [(*(list(r) + [None] * 4)[:4], None if r[1] is None else len(r[1]), "r", "s", "f", "sc", 7, 0.5, "d", "k", "ro", "ke") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one long text, words beyond ASCII."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(30_000))
    same = " ".join(word() for _ in range(120))
    rows = [
        (None, same, "en", "a"), (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "de", None), (4, same, "en", "b"), (5, same + " ", "en", "b"), (5, same + " ", "en", "b"),
        (6, same.replace(" ", "\n"), None, "b"), (7, long, "en", "a"), (8, "ONE two", "de", "c"), (9, "one TWO", "de", None), (10, "x", "fr", ""), (11, "É ß 😀 word", "fr", "c"),
        (12, "12345 --- 678", "fr", "c"), (13, long[:5000] + " tail", "en", "b"), (5, "other text of the same id", "en", "b"), (None, None, None, None),
    ]
    return rows
