import pytest

#: Texts that every operator must take: null, empty, blank, repeated, very long.
LONG = "word " * 40_000 + "end"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows: nulls in every column, repeated rows and ids, and a clashing extra column."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, " \n\t ", "en", "s", 4, None), (4, "one two three", "en", "s", 13, "x"), (4, "one two three", "en", "s", 13, "x"), (4, "another text of that id", "en", "s", 23, "x"), (None, "no id at all here", "en", "s", 17, "x"), (5, LONG, "en", "s", len(LONG), "x"), (6, "é" * 5000, "fr", "s", 5000, "x"), (7, LONG, "en", "s", len(LONG), "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
