"""Ingestion progress: an append-only table of events, read from any offset or as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job_id string, seq long, stage string, detail string, pct int, ts timestamp"

# The stages of an ingestion and how far each has come.
STAGES = {"loading": 10, "chunking": 30, "embedding": 50, "saving": 80, "graph": 90, "done": 100, "error": -1}


def append(spark: SparkSession, path: str, job_id: str, seq: int, stage: str, detail: str = "") -> None:
    """Add one event."""
    row = spark.createDataFrame([(job_id, seq, stage, detail, STAGES[stage])], "job_id string, seq long, stage string, detail string, pct int")
    row.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, job_id: str, offset: int = 0) -> DataFrame:
    """A job's events from an offset on, in order."""
    return spark.read.schema(SCHEMA).parquet(path).where((F.col("job_id") == job_id) & (F.col("seq") >= offset)).orderBy("seq")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """All events as they come."""
    return spark.readStream.schema(SCHEMA).parquet(path)
