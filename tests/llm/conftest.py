import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table; rows are (doc_id, text[, lang[, source]])."""

    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        from pyspark.sql import functions as F

        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The whole documents table of the smallest size, as rows and as a DataFrame."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, df.orderBy("doc_id").collect()
