import re

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, pattern, lower=True):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return re.findall(pattern, raw)


SPACED = rb"[^\x20\x09-\x0D]+"
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (4, long, "en", "s", len(long)),
        (5, long, "de", "s", len(long)), (None, "null id text here now", "en", "s", 5), (6, "é漢😀 \t\n\n  x", None, "s", 9), (7, "\x00\x01 a\x00b", "en", "s", 5), (8, "a " * 400, "en", "s", 800),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "1 as key", "2 as rep", "'x' as band", "3 as start", "4 as component_id", "5 as _kept", "6 as `a.b`")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
