import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, _row string, `block` long, `key` string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnopqrst") + r.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, words(1, 80), "en", "a"), (1, words(1, 80), "en", "a"), (2, words(1, 80), "en", "a"),
        (3, None, "en", "a"), (4, "", "en", None), (5, "   \n\t ", None, "a"), (None, words(2, 70), "de", "b"),
        (None, None, None, None), (6, words(3, 30_000), "de", "b"), (7, "9" * 20_000, "de", "b"),
        (8, "a" * 20_000, None, None), (9, "é" * 30 + " \U0001F600 " + words(4, 60), "fr", "a"), (10, "!?#$ " * 60, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, g, s, None, "x", "y", 5, "k") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
