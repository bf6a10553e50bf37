import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, lang]) rows, dealt over several partitions."""

    def make(rows, schema=DOCS):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table as Python rows."""
    path = "/root/testdata/sf0.001/documents.parquet"
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(path).select("doc_id", "text", "lang").collect()]
