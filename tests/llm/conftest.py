import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Null in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", 1),
        (2, "one two three four five six seven eight nine ten", "en", 2),
        (3, None, None, None),
        (4, "", "", 0),
        (5, " \t\n", "x", 3),
        (6, LONG, "en", 4),
        (7, "one  two three four\nfive six seven eight nine ten", "en", 5),
        (8, "repeated row", "en", 6),
        (8, "repeated row", "en", 6),
        (None, "nobody", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, data long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
