import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "id int, h string, size string, fp int, key string, target string, spans int, words string")


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names occur inside the operators."""
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), 1, "x", "y", 2, "k", None, 3, "w") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    base = words(rng, 300)
    rows = [(1, base, "aa", "s1"), (2, base, "aa", "s1"), (3, base + " extra", None, None),
            (4, None, "aa", "s1"), (5, "", None, "s2"), (6, " \n\t ", "bb", "s2"), (None, words(rng, 60), "aa", "s1"),
            (None, None, None, None), (7, words(rng, 80), "bb", None), (7, words(rng, 80), "bb", None),
            (8, words(rng, 30_000), "aa", "s3"), (9, "one", "aa", "s3"), (10, "a" * 50_000, "bb", "s3"),
            (11, "12 34 !!", None, "s2")]
    return rows + [rows[0]] + [(12, rows[8][1], "bb", "s2")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return table(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
