import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a DataFrame, with columns that clash with the operators' own working names."""

    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "hash", "rank", "salt", "block", "level", "found", "_p"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("clash"))
        return df

    return make
