import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows with the columns of ``documents``, with others beside them whose names clash with outputs."""

    def make(rows, extra=True):
        data = [(i, t, lang, src, len(t or ""), -1, True) for i, t, lang, src in rows]
        df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int, kept boolean")
        return df if extra else df.drop("n_tokens", "kept")

    return make
