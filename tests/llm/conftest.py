import pytest


@pytest.fixture
def docs(spark):
    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, columns)

    return make
