"""Documents with every awkward case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, score string"


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 70),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 70),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 70),
        (3, "The quick  brown fox jumps over\nthe lazy dog near the old river bank today.", "en", "b", 71),
        (4, None, None, None, None),
        (5, "", "de", "b", 0),
        (6, "   \n\t ", "de", "b", 6),
        (7, "one two", "en", None, 7),
        (8, "ONE TWO", "en", "c", 7),
        (None, "a text without an id, but with enough words for a shingle or two", "en", "c", 60),
        (None, "another text without an id, and with other words than the one before", "en", "c", 60),
        (9, long, "en", "a", len(long)),
        (10, long + " end", "en", "a", len(long) + 4),
        (11, "1234 5678 !!! ### $$$", None, "d", 20),
        (12, "<|endoftext|> ends <|endoftext|> here  now \u00a0 x", "en", "d", 40),
        (13, "Ünïcödé ñandú\x00 nul and é́ combining   marks", "es", "d", 30),
    ]
    return [(*r, "x", None) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
