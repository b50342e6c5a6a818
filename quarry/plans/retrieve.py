"""From questions to prompts: rewrite, search, rerank, expand along the graph, assemble."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import bm25, fusion, graph, prompt, vector
from quarry.settings import Settings


DEFAULTS = Settings()


@dataclass(frozen=True)
class Index:
    """What retrieval reads: chunks, their vectors, BM25 tables and edges; `embed(query_id, query)` gives `query_id`, `embedding`."""

    chunks: DataFrame
    vectors: DataFrame
    words: bm25.Bm25
    edges: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None


def search(index: Index, queries: DataFrame, keywords: bool = True, settings: Settings = DEFAULTS, final_k: int | None = None) -> DataFrame:
    """Hits as `query_id`, `rank`, `chunk_id`: hybrid, or by vectors alone where there is no keyword index."""
    last = settings.final_k if final_k is None else final_k
    if keywords:
        found = fusion.hybrid(index.words, index.vectors, queries, settings.search_k, last, settings.hybrid_cut)
    else:
        found = vector.cut(vector.nearest(index.vectors, queries, settings.search_k), settings.vector_cut, last)
    return found.select("query_id", "rank", "chunk_id")


def rewritten(index: Index, queries: DataFrame, history: DataFrame) -> DataFrame:
    """`queries` as they are searched: completed from the history, with the vectors of the completed questions.

    Where the index cannot embed, a question that stays as it was keeps its vector; the others have
    none and are searched by their words.
    """
    new = queries.join(prompt.rewrite(history, queries), "query_id")
    if index.embed is None:
        given = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<float>")
        return new.withColumn("embedding", F.when(F.col("rewritten") == F.col("query"), given)).withColumn("query", F.col("rewritten")).drop("rewritten")
    new = new.drop("embedding").withColumn("query", F.col("rewritten")).drop("rewritten")
    return new.join(index.embed(new.select("query_id", "query")), "query_id", "left")


def retrieve(index: Index, queries: DataFrame, history: DataFrame | None = None, keywords: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """The sources of each query in order: chunk columns, `rank`, `is_graph`.

    `queries(query_id, query, embedding)`. The search sees the rewritten question and its vector,
    the reranking the original question; graph chunks follow the hits.
    """
    asked = queries if history is None else rewritten(index, queries, history)
    hits = search(index, asked, keywords, settings).join(index.chunks, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    best = fusion.rerank(hits, keep=settings.rerank_keep).drop("overlap", "query").withColumn("is_graph", F.lit(False))
    if index.edges is None:
        return best
    near = graph.expand(best, index.chunks, index.edges, settings.graph_chunks).select("query_id", "chunk_id", F.col("rank").alias("_r"))
    extra = near.join(index.chunks, "chunk_id").withColumn("rank", F.col("_r") + 1000).withColumn("is_graph", F.lit(True)).drop("_r")
    return best.unionByName(extra.select(*best.columns))


def prompts(index: Index, queries: DataFrame, history: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """`query_id`, `messages`: what a language model is asked. The call itself stays outside."""
    return prompt.messages(queries, prompt.context(retrieve(index, queries, history, settings=settings)), history, settings.prompt_turns)
