import pytest


@pytest.fixture()
def docs(spark):
    """Rows (doc_id, text, more...) with a schema of their own."""
    def make(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema)
    return make
