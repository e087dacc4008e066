import pytest

LONG = " ".join(f"w{k % 900} x{k}" for k in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "Alpha beta gamma delta.\nSame line here today.", "en", "a", 10, "x"),
        (1, "Alpha beta gamma delta.\nSame line here today.", "en", "a", 10, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "b", 0, "y"),
        (4, "  \n\t ", "en", "b", 4, "y"),
        (5, LONG, "en", "c", len(LONG), "z"),
        (6, "one", "de", "d", 3, "z"),
        (7, "Alpha beta gamma delta.\nSame line here today.", "en", "e", 10, "x"),
        (None, "Nobody's text.\nSame line here today.", "en", "f", 5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
