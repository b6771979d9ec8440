import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra)

    return make
