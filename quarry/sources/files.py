"""Source trees as tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import base_name, line_count, suffix

# The endings that are read.
ENDINGS = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".html", ".css", ".json", ".yaml", ".yml", ".go", ".rs", ".rb", ".sh")


def scan(spark: SparkSession, root: str, project_id: str = "default") -> DataFrame:
    """Files under `root`: `project_id`, `path` (relative), `file_name`, `content`, `file_ord` (by path).

    Endings count in their own case; files that are no UTF-8 are left out; \\r\\n and \\r become \\n.
    The root is resolved first and cut off as a prefix, so a folder below it may have its name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    # Spark names a file by its URI, and so is the root: of equal schemes and escapes, one is a prefix of the other.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = system.resolvePath(place).toString().rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(top)), F.substr("path", F.lit(len(top) + 1))).otherwise(F.raise_error(F.concat(F.lit(f"not under {top}: "), F.col("path"))))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = raw.select(relative.alias("path"), F.regexp_replace(text, "\r\n?", "\n").alias("content"))
    files = files.where(suffix("path").isin(*ENDINGS) & F.col("content").isNotNull())
    files = files.select(F.lit(project_id).alias("project_id"), "path", base_name("path").alias("file_name"), "content")
    return numbered(files, ["path"], "file_ord")


def from_documents(documents: DataFrame) -> DataFrame:
    """The documents that are files, in the shape of `scan`; `file_ord` is the doc_id."""
    rows = documents.where("path is not null and content is not null")
    return rows.select("project_id", "path", "file_name", F.regexp_replace("content", "\r\n?", "\n").alias("content"), F.col("doc_id").alias("file_ord"))


def numbered(rows: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Rows numbered from 0 in the given order as `name`: offsets of range partitions, so no single task sorts everything."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from quarry.plans.scratch import written

    fixed = written(ranged, "numbered")
    sizes = fixed.groupBy("_p").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_p", before.alias("_o")))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return fixed.withColumn("_w", within).join(offsets, "_p").withColumn(name, F.col("_o") + F.col("_w")).drop("_p", "_o", "_w")


def listing(chunks: DataFrame) -> DataFrame:
    """Indexed files: `project_id`, `path`, `file_name`, `chunks`, `types` (distinct, in first-seen order, joined by commas)."""
    first = chunks.where(F.coalesce("type", F.lit("")) != "").groupBy("project_id", "path", "type").agg(F.min("chunk_id").alias("seen"))
    types = first.groupBy("project_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "type"))), lambda x: x.type), ",").alias("types"))
    files = chunks.groupBy("project_id", "path").agg(F.min_by("file_name", "chunk_id").alias("file_name"), F.count("*").alias("chunks"))
    return files.join(types, ["project_id", "path"], "left").select("project_id", "path", "file_name", "chunks", F.coalesce("types", F.lit("")).alias("types"))


def source(files: DataFrame, chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The sources asked for, of indexed files only: `project_id`, `path`, `content`, `lines`."""
    asked = paths.join(chunks.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    return files.join(asked, ["project_id", "path"], "left_semi").select("project_id", "path", "content", line_count("content").alias("lines"))
