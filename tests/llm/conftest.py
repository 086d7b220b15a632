import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, node bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names clash with internal ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "extra", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
