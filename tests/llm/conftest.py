import hashlib

import pytest

#: doc_id, text, lang, source, n_chars: nulls in any column, empties, ties, repeated rows, long texts.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog today\nshared line of text\nbye", "en", "a", 70),
    (2, "the quick brown fox jumps over the lazy dog today\nSHARED line of text  \nhello", "en", "a", 70),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "one two", "en", None, 7),
    (5, "one two", "en", None, 7),
    (None, "shared line of text", "en", "b", 19),
    (7, "mail a.b@c.org now +1 (988) 555-2485 or 42.144.35.254", None, "c", 50),
    (8, "word " * 5000, "en", "a", 25000),
    (9, "x" * 30000, "de", "c", 30000),
    (10, "é ü 日本語 🙂 'tis 12٣ \t\n\n  end ", "zz", "c", 20),
    (11, "one two", "en", "b", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """With columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).select("*", F.lit(1).alias("score"), F.lit("x").alias("id"), F.lit(2).alias("label"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("set"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
