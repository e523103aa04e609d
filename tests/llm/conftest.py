from __future__ import annotations

import pytest

from chatloom.session import ship


@pytest.fixture(scope="session")
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def odd_docs(shipped):
    """Documents with nulls, blanks, repeats, ties, long words and texts, and columns with awkward names."""
    long_text = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, "a b c d e", "x"),
        (2, None, "x"),
        (3, "", None),
        (4, "  \n\t ", "x"),
        (5, "a b c d e", "y"),
        (5, "a b c d e", "y"),
        (None, "a b c d e", "y"),
        (None, None, None),
        (6, long_text, "x"),
        (7, "z" * 200000, "x"),
        (8, "é" * 3000 + " ☃ 😀", "é"),
        (9, "one", "x"),
    ]
    df = shipped.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("key"), F.lit(2).alias("h"), F.lit("q").alias("units"), F.lit(3).alias("n"), F.lit("b").alias("body"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
