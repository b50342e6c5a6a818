"""From a source tree to a stored index: scan, chunk, embed, save, graph; each stage reported."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import bm25, chunking, graph
from quarry.plans import keywords
from quarry.plans.retrieve import Index
from quarry.settings import Settings
from quarry.sources import files, index
from quarry.streaming import progress

TABLES = ("files", "chunks", "vectors", "keywords", "imports", "edges")


class EmptySource(ValueError):
    """A source tree without a file that is read."""


def ingest(
    spark: SparkSession, source: str | DataFrame, project_id: str, settings: Settings, job_id: str | None = None, model: Callable[[], index.Embedder] = lambda: index.hashed
) -> str:
    """Index a folder (or a table of files in the shape of `files.scan`) as one project; returns the job's id.

    The project's old index is replaced, other projects stay. Every stage is written before the
    next one reads it, so a lost executor costs its tasks only. A source without files raises
    EmptySource and leaves the old index; any error is reported as the stage `error`.
    """
    job, log = job_id or uuid.uuid4().hex[:8], settings.table("progress")
    stages = iter(range(1_000_000))

    def at(stage: str, detail: str = "") -> None:
        progress.append(spark, log, job, next(stages), stage, detail)

    try:
        at("loading")
        found = files.scan(spark, source, project_id) if isinstance(source, str) else source
        if found.isEmpty():
            raise EmptySource(project_id)
        index.save(found, settings.table("files"))
        found = index.load(spark, settings.table("files"), project_id)
        at("chunking")
        cut = files.numbered(chunking.chunk_files(found), ["path", "start_line", "end_line", "name", "content"])
        index.save(cut, settings.table("chunks"))
        chunks = index.load(spark, settings.table("chunks"), project_id)
        at("embedding", f"{chunks.count()} chunks")
        vectors = index.embedded(chunks.select("project_id", "chunk_id", "content"), model=model).drop("content")
        at("saving")
        index.save(vectors, settings.table("vectors"))
        keywords.save(bm25.fit(chunks), settings.table("keywords"), project_id)
        at("graph")
        imports, edges = graph.build(found)
        index.save(imports, settings.table("imports"))
        index.save(edges, settings.table("edges"))
        at("done")
    except Exception as error:
        at("error", str(error)[:500])
        raise
    return job


def load(spark: SparkSession, project_id: str, settings: Settings, model: Callable[[], index.Embedder] = lambda: index.hashed) -> Index | None:
    """A project's index, read from its own folders alone; None where it has no chunks or no vectors. `model` embeds questions."""
    try:
        chunks, vectors = (index.load(spark, settings.table(t), project_id) for t in ("chunks", "vectors"))
        edges = index.load(spark, settings.table("edges"), project_id, "src string, dst string, project_id string")
        words = keywords.load(spark, settings.table("keywords"), project_id)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    def embed(queries: DataFrame) -> DataFrame:
        return index.embedded(queries, "query", model).select("query_id", "embedding")

    return Index(chunks, vectors, words, edges, embed) if index.ready(chunks, vectors) else None
