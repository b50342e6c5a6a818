"""Reciprocal rank fusion, hybrid search and reranking by keyword overlap."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import split_words
from quarry.operators import bm25, vector

RRF_K = 60


def reciprocal_ranks(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Ranked lists (`query_id`, `chunk_id`, `rank` from 0) fused: `query_id`, `chunk_id`, `rrf_score`, `rank`.

    A chunk's score is the sum of 1 / (k + rank + 1); ties keep the order in which the lists,
    one after the other, first show the chunk.
    """
    parts = [x.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("list")) for n, x in enumerate(lists)]
    pool = reduce(DataFrame.unionByName, parts)
    fused = pool.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 12).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen")
    return fused.withColumn("rank", F.row_number().over(order) - 1).drop("seen")


def hybrid(index: bm25.Bm25, vectors: DataFrame, queries: DataFrame, k: int = 20, final_k: int = 5, below: float = 2.0) -> DataFrame:
    """Vector and keyword search fused: `query_id`, `rank`, `chunk_id`, `rrf_score`, `bm25_score` (both to 4 digits).

    `queries(query_id, query, embedding)`. Chunk texts take no part; join them to the few rows that come out.
    """
    found = bm25.scores(index, queries)
    words = bm25.ranked(index, queries, k, found=found)
    near = vector.cut(vector.nearest(vectors, queries, k), below)
    fused = reciprocal_ranks([near, words]).where(F.col("rank") < final_k)
    scored = fused.join(found, ["query_id", "chunk_id"], "left")
    return scored.select(
        "query_id", "rank", "chunk_id", F.bround("rrf_score", 4).alias("rrf_score"), F.bround(F.coalesce("score", F.lit(0.0)), 4).alias("bm25_score")
    )


def rerank(hits: DataFrame, query: str = "query", content: str = "content", keep: int = 3) -> DataFrame:
    """Hits by how many of the query's distinct words their text contains; ties keep their rank.

    `hits(query_id, rank, query, content, ...)` -> with `overlap` and the new `rank`.
    """
    asked = F.array_distinct(split_words(F.lower(query)))
    text = F.lower(F.coalesce(content, F.lit("")))
    overlap = F.size(F.filter(asked, lambda w: F.contains(text, w)))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    ranked = hits.withColumn("overlap", F.coalesce(overlap, F.lit(0))).withColumn("again", F.row_number().over(order) - 1)
    return ranked.where(F.col("again") < keep).withColumn("rank", F.col("again")).drop("again")
