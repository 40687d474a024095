import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, n int, size long, words double, k0 string, mix string, label int, "
          "node long, h long, w string, __near_row string, psrc string, `odd.name` string")
EXTRA = ("x", 1, 2, 3.0, "k", "m", 1, 9, 8, "w", "r", "p", "dot")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, *EXTRA)


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents that also has columns named like those that operators use inside."""
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def prose():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvé") for _ in range(rnd.randint(2, 8))) for _ in range(400)]

    def make(words, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(words))
    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a repeated key."""
    return [(1, prose(60, 1)), (2, None, None, None), (3, "", "de", "b"), (None, prose(40, 2), "fr", None), (4, prose(30_000, 3), "es", "a"),
            (5, prose(60, 1)), (5, prose(60, 1)), (6, "one two"), (7, "one two", None, "c"), (6, prose(50, 5)), (8, " \t\n "), (9, "x" * 50_000, "en", "")]


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The tables are tiny and some operators take many small steps."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
