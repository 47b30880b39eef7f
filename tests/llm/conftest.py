import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with clashing extra columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("key", T.StringType()),
                           T.StructField("label", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "k", 1, 2) for r in rows], schema)

    return make
