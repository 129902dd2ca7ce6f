import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with a column that clashes with operators' own names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
