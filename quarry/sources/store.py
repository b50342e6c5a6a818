"""Tables that grow by appending: created empty with their schema, rows checked before they are written."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def create(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty table, where there is none yet."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows under its schema; columns that older files lack are null."""
    return spark.read.schema(schema).parquet(path)


def insert(rows: DataFrame, path: str, schema: StructType) -> None:
    """Append rows; missing nullable columns become null. A null in a required column raises before anything is written."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    checked = [
        F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} must not be null"))).otherwise(c).cast(f.dataType).alias(f.name) if not f.nullable else c
        for c, f in zip(columns, schema)
    ]
    rows.select(*checked).write.mode("append").parquet(path)


def with_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """Rows under new random ids. They are drawn anew each time the frame is computed: write it once, then read it."""
    return rows.withColumn(column, F.uuid())


def write_report(reports: DataFrame, path: str) -> None:
    """Evaluation reports (`run`, ...) as one JSON document per line, in one file."""
    reports.coalesce(1).write.mode("overwrite").json(path)


def pretty(value: Column) -> Column:
    """A struct as an indented JSON text."""
    return F.to_json(value, {"pretty": "true"})


def report_json(reports: DataFrame, run: str = "run") -> DataFrame:
    """Each report as `run` and its numbers as one JSON object."""
    numbers = [c for c in reports.columns if c != run]
    return reports.select(run, F.to_json(F.struct(*numbers)).alias("json"))
