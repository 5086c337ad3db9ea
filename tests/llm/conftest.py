import pytest


@pytest.fixture
def documents(spark):
    """Rows as a table with the columns of ``documents`` and one with a clashing name."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int")

    return make
