import pytest
from pyspark.sql import types as T


@pytest.fixture
def scratch(spark):
    from barweave.llm.scratch import Scratch
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) -> a frame, with columns whose names clash with those that operators add."""
    def make(rows, parts=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.StringType()),
                               T.StructField("KEPT", T.StringType()), T.StructField("epoch", T.StringType()), T.StructField("n_replaced", T.StringType()), T.StructField("key", T.StringType())])
        full = [(d, t, s[0] if s else "s", "x", "x", "x", "x", "x") for d, t, *s in rows]
        return spark.createDataFrame(full, schema).repartition(parts)
    return make
