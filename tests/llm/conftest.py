import pytest

NULLS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (None, "no id here"), (7, "Très long " * 4000), (7, "Très long " * 4000)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, blank, short, very long and repeated texts, and columns with clashing names."""
    rows = [(i, t, "s" if i else None, 9, 0) for i, t in NULLS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, component_id int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
