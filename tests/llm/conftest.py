import pytest

DOC = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema=DOC):
        return spark.createDataFrame(rows, schema)

    return make
