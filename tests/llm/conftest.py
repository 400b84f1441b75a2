import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "the", "on", "ier", "ung", "ción", "ß", "eux", "ing"]) for _ in range(r.randint(1, 4)))
    shared = " ".join(word() for _ in range(140))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 120))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), 1) for i in range(60)]
    rows += [(100 + i, word() + " " + shared + f" {word()} {i}", "en", "a", None) for i in range(12)]
    rows += [(200 + i, rows[3][1], "fr", "b", 2) for i in range(15)]  # copies
    rows += [(300, None, None, None, None), (301, "", "en", "c", 0), (302, " \t\n", "en", "c", 3), (None, "no id here", "en", "a", 4), (303, "\x1c\x85 x y", "en", "a", 5)]
    rows += [(304, (shared + " ") * 6, "de", None, 6), (305, "a" * 5000, "de", "d", 7), (305, "a" * 5000, "de", "d", 7), (306, "12 34 !! ##", "en", "d", 8)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, COLUMNS)
    return df.withColumns({c: F.lit("x") for c in ("fp", "root", "size", "pack", "bucket", "key", "cell", "_id", "hash", "answer", "shard", "target", "component_id")}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
