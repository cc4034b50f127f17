import pytest

pytest.importorskip("auditloom.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, `row` long, `key` string, n int"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts or rows (doc_id, text[, lang, source]), with columns whose names clash."""

    def make(rows):
        full = []
        for k, x in enumerate(rows):
            doc_id, text, lang, source = (*x, *(None,) * (4 - len(x))) if isinstance(x, tuple) else (k, x, "en", "src0")
            full.append((doc_id, text, lang, source, len(text) if text else None, "s", None, 1, "k", 2))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
