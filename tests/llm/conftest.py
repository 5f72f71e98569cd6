from __future__ import annotations

import random

import pytest


@pytest.fixture(autouse=True)
def small_sketches(monkeypatch):
    """Sketches of a size that suits a few rows."""
    from stormglass.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "LOG2_CELLS", 17)


#: Rows that any operator on documents must bear: nulls, empty and blank texts, a very long
#: one, repeated rows, one id with two texts, and columns with names of the operators' own.
def awkward_rows() -> list[tuple]:
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = " ".join(word() for _ in range(30_000))
    body = " ".join(word() for _ in range(120))
    return [
        (1, body, "en", 1), (1, body, "en", 1), (2, body, "en", None), (3, None, None, 3), (4, "", "en", 4), (5, " \t\n ", "en", 5), (6, "one two", "en", 6),
        (7, long, "de", 7), (8, long, "de", 8), (None, body, "en", 9), (None, None, None, 10), (9, "a\nb\na\nb", "fr", 11), (9, "é ü ñ", "fr", 12), (10, body + " tail", "en", 13),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    names = "doc_id long, text string, lang string, n int"
    df = spark.createDataFrame(awkward_rows(), names)
    clash = {c: df["n"] for c in ("chunk", "sha", "node", "comp", "tokens", "text_key", "row_key", "digest", "start", "score", "kept", "n_words", "quality", "toxic", "label", "rep", "piece", "_id")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
