from __future__ import annotations

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, row string, bucket int"

LONG = "One Two three four five six. " * 4000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and column names the operators use."""
    texts = [
        (1, "alpha beta gamma delta epsilon zeta\nshared line\n", "en", "a"), (2, None, "en", "a"),
        (3, "", None, None), (4, "   \n\t ", "de", "b"), (None, "alpha beta gamma delta epsilon zeta", "en", None),
        (5, LONG, "en", "b"), (6, LONG, "fr", "c"), (6, LONG, "fr", "c"), (7, "12345 !!! ###", None, "c"),
        (8, "für é ñ 語 😀 <|endoftext|> tail", "de", "a"), (9, "one two", "en", "b"), (10, "one two", "en", "b"),
        (None, None, None, None), (11, "licensed under the MIT License\nshared line", "en", "d"),
        (12, "x" * 50_000, "fr", "d"),
    ]
    return [(i, t, g, s, None if t is None else len(t), "x", None, 3) for i, t, g, s in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def corpus():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
