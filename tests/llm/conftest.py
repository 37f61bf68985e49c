import pytest


@pytest.fixture()
def frame(spark):
    """rows and a schema to a DataFrame, over several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
