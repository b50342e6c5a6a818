"""Written intermediate tables: they cut lineage and outlive lost executors.

The folder is the cluster's shared `spark.checkpoint.dir`; only where that is unset (tests, a
notebook) a temporary folder of this process takes its place.
"""

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with this process's intermediate tables."""
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """`df` computed once, written as parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end: for a long session, once a result is stored."""
    before = len(_written)
    try:
        yield
    finally:
        drop_written(spark, before)


def drop_written(spark: SparkSession, keep: int = 0) -> None:
    """Delete the intermediate tables of this process, but for the first `keep`."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            drop_written(spark)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
