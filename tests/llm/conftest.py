from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text[, lang[, source]])."""
    def build(rows, schema=SCHEMA):
        full = []
        for doc_id, text, *rest in rows:
            lang, source = [*rest, "en", "s0"][:2] if len(rest) < 2 else rest
            full.append((doc_id, text, lang, source, len(text) if text else 0))
        return spark.createDataFrame(full, schema)

    return build


def odd_rows():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows."""
    plain = "The quick brown fox jumps over the lazy dog near the quiet river bank while seven small birds sing above old trees"
    return [
        (None, plain, None, None), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "de", None),
        (4, plain, "en", "a"), (4, plain, "en", "a"), (5, plain, "en", "b"), (6, "word " * 30_000, "en", "a"),
        (7, "été über ñandú 世界 " + plain, "fr", "b"), (8, "one two", "en", "a"), (9, "?? 123 --", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names clash with those the operators make."""
    rows = [(*r, 0, 7, "x", True, 1) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, "
                                       "kept boolean, score int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
