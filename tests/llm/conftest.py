import pytest

from touchline.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]); two columns whose names operators use themselves come along."""

    def build(rows, schema="doc_id long, text string, source string"):
        width = len(schema.split(","))
        rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame([r + (7, "x") for r in rows], schema + ", key int, component string")

    return build
