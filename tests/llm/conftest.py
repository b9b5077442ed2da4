import pytest

LONG = "word " * 200_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns whose names clash with results."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids string, size string, band string, lang_pred string, rank int"
    rest = (9.0, False, "x", "y", "z", "q", 1)
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.\nAlpha beta gamma delta epsilon zeta.", "en", "b", 5, *rest),
        (1, "Alpha beta gamma delta epsilon zeta.\nAlpha beta gamma delta epsilon zeta.", "en", "b", 5, *rest),
        (2, None, "en", None, None, *rest),
        (3, "", None, "a", 0, *rest),
        (4, " \t\n", "de", "a", 3, *rest),
        (5, LONG, "en", "a", len(LONG), *rest),
        (6, "Ärger 日本語   ✓ ①", "de", "c", 10, *rest),
        (7, "12345 ... !!!", None, "c", 13, *rest),
        (8, None, None, None, None, *rest),
        (None, "No id at all", "en", "a", 3, *rest),
        (None, None, None, None, None, *[None] * 7),
    ]
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
