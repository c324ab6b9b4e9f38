import pytest

TEXTS = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def texts(spark):
    return lambda rows: spark.createDataFrame(rows, TEXTS)
