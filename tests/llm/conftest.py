import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


@pytest.fixture
def docs(spark):
    def make(texts, langs=None, sources=None):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
