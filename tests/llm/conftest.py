import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def odd_documents(spark):
    """Null and empty texts, a null id, a repeated row and clashing extra columns."""
    rows = [(1, "Plain words of a text that goes on.", "x", "y"), (2, None, None, None), (3, "", "a", "b"), (None, "No id here at all, but words.", "a", "b"), (1, "Plain words of a text that goes on.", "x", "y"), (5, "Ünïcödé \U0001f600 \x00 ok", "q", "r"), (6, "word " * 3000, "s", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, score string").selectExpr("*", "'en' AS lang", "1 AS n_chars", "'z' AS packed", "2 AS key", "'s' AS source")
