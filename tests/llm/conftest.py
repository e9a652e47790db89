import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts or (doc_id, text) pairs, in two partitions."""

    def make(texts, schema=DOCS):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, schema).repartition(2)

    return make
