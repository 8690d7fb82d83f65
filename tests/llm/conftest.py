import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, kept string, h string, scan int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source), with further columns whose names clash with the operators' own."""

    def documents(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y", 2) for i, t, s in rows], DOCS)

    return documents


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, None, "a"),
        (2, "", None),
        (3, "   \n\t ", "a"),
        (4, "one", "b"),
        (5, "Same text here for all of us", "b"),
        (6, "same TEXT here for all of us", "b"),
        (7, "same text here for all of us", None),
        (7, "same text here for all of us", None),
        (8, LONG, "c"),
        (9, LONG + " tail", "c"),
        (None, "a text without an id", "a"),
        (10, "ÉTÉ été ▁ \U0001f600 İstanbul ſecret", "d"),
    ]
