import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) or full rows."""

    def make(rows):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in full], "doc_id long, text string, lang string, source string, n_chars long")

    return make
