"""Reading the named parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; a lazy scan, so pruning and pushdown reach parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer pieces than half the cores, dealt out to all of them before costly work; others as they are.

    Tables that matter at scale have many files or row groups and are never shuffled here.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows
