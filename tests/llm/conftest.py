import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and then " * 4000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and an extra column with a clashing name."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 10),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 10),
        (2, "alpha BETA gamma delta epsilon zeta", "en", "a", 10),
        (3, "", None, None, None),
        (4, None, "en", None, 0),
        (5, " \t\n", "de", "b", 3),
        (6, LONG, "en", "a", len(LONG)),
        (7, LONG, None, "c", len(LONG)),
        (None, "nobody's words are here for all to see", "fr", "b", 5),
        (None, None, None, None, None),
        (8, "one two", "en", "c", 7),
        (9, "ONE  two", "de", "c", 8),
        (10, "12345 !!! ---", "en", "c", 13),
    ]
    docs = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], f"{COLUMNS}, _text string, shard int, n long")
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
