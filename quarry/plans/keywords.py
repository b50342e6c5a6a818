"""The stored keyword index: BM25 tables written once, their postings in folders by term, and read again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.plans.scratch import shared_path
from quarry.sources import index
from quarry.sources.store import exists
from quarry.sources.tables import spread

_stored: dict[tuple, str] = {}


def save(words: bm25.Bm25, place: str, project_id: str) -> None:
    """Write the index of a project below `place`; other projects' stay. Frequencies and the corpus row are summed from what is written."""
    spark = words.postings.sparkSession

    def put(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
        index.save(rows.withColumn("project_id", F.lit(project_id)), f"{place}/{name}", by)
        return index.load(spark, f"{place}/{name}", project_id)

    postings = put(bm25.bucketed(words.postings, "chunk_id"), "postings", ["bucket"])
    frequencies, corpus = bm25.summed(postings, put(words.lengths, "lengths", []))
    put(bm25.bucketed(frequencies), "frequencies", ["bucket"])
    put(corpus, "corpus", [])


def load(spark: SparkSession, place: str, project_id: str) -> bm25.Bm25:
    """The stored index of a project. A question reads the folders of its own terms."""
    return bm25.Bm25(*(index.load(spark, f"{place}/{name}", project_id).drop("project_id") for name in ("postings", "lengths", "frequencies", "corpus")))


def of_table(chunks: DataFrame, content: str = "content") -> bm25.Bm25:
    """The index of a table's chunks, built when its files are first asked for in a session and kept until they change."""
    spark = chunks.sparkSession
    key = (spark.sparkContext.applicationId, *sorted(_versions(spark, chunks.inputFiles())))
    if key not in _stored or not exists(spark, _stored[key]):
        place = shared_path(spark, "keywords")
        save(bm25.fit(spread(chunks.select("chunk_id", content)), content), place, "all")
        _stored[key] = place
    return load(spark, _stored[key], "all")


def _versions(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in files:
        status = path(name).getFileSystem(conf).getFileStatus(path(name))
        found.append((name, status.getLen(), status.getModificationTime()))
    return found
