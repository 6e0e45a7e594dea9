from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, repeated rows, ties, and columns whose names the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, `_fp` string, `a.b` string, row string"
LONG = " ".join(f"word{i % 997} the of" for i in range(4000))
ROWS = [
    (1, "The cat sat on the mat and the dog of the house was in that room with it for a while on this day.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "xx"),
    (5, "Same text twice", "en"),
    (6, "Same text twice", "en"),
    (6, "Same text twice", "en"),
    (None, "Same text twice", "en"),
    (None, None, None),
    (7, LONG, "en"),
    (8, "naïve Ünïcode 👩‍👩‍👧 ǅ ᵺ é <|endoftext|> 12'34 don't", "fr"),
    (9, "token = \"" + "a1" * 20 + "\"\nuser: alice", "de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, lang, "s", len(t or ""), "x", "y", "z", "r") for d, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts(spark, pairs):
    return spark.createDataFrame([(d, t, "en") for d, t in pairs], "doc_id bigint, text string, lang string")
