"""The stored index: one folder per project, so that loading one project reads only its own."""

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 384
_TOKEN = re.compile(r"\w+")
Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Stand-in embeddings where no model is at hand: each token adds or takes 1 at a place its hash names, then length 1.

    Texts with common tokens are near each other; a text without a token lies along the first axis.
    """
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(out, texts):
        for token in _TOKEN.findall(text.lower()):
            place = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
            row[(place >> 1) % dim] += 1.0 if place & 1 else -1.0
        if not row.any():
            row[0] = 1.0
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embedded(rows: DataFrame, text: str = "content", model: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """`rows` with `embedding`. Each distinct text is embedded once; `model` is loaded once per Python worker. Null texts get none."""
    distinct = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        for batch in batches:
            yield batch.assign(embedding=list(embed(batch["_text"].tolist())))

    vectors = distinct.mapInPandas(run, "_text string, embedding array<float>")
    return rows.join(vectors, rows[text] == vectors["_text"], "left").drop("_text")


def save(table: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write a table of the index; the projects it holds are replaced, others stay. `by` names further folders below a project."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("project_id", *(by or [])).parquet(path)


def load(spark: SparkSession, path: str, project_id: str | None = None, schema: str | None = None) -> DataFrame:
    """A table of the index, or one project of it (its folder alone is read). With its `schema` a table may be without rows."""
    rows = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


def stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """`project_id`, `files`, `chunks`, `vectors`."""
    counted = chunks.groupBy("project_id").agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks"))
    held = vectors.groupBy("project_id").agg(F.count_distinct("chunk_id").alias("vectors"))
    return counted.join(held, "project_id", "left").select("project_id", "files", "chunks", F.coalesce("vectors", F.lit(0)).alias("vectors"))


def ready(chunks: DataFrame, vectors: DataFrame) -> bool:
    """Whether an index can answer: it has chunks and vectors."""
    return not chunks.isEmpty() and not vectors.isEmpty()
