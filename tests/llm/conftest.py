import pytest

WEIRD = [(None, None), (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "Two Words"), (6, "two words"), (7, "x" * 50_000), (8, "word " * 5_000), (9, "é 日本 🙂"), (9, "é 日本 🙂"), (10, "two words")]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls, empty, blank, very long and repeated rows, ties, and columns with clashing names."""
    names = "score string, pii string, digest string, row long, n long, `class` string"
    rows = [(i, t, "s", None, "d", 1, 2, "c") for i, t in WEIRD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}")


@pytest.fixture(scope="session")
def nothing(spark, weird):
    return spark.createDataFrame([], weird.schema)
