"""Exact nearest neighbours by squared Euclidean distance.

Up to `QUERIES_AT_ONCE` queries go to every task as one matrix. More are dealt with the rows: rows
and queries are cut into blocks by a shuffle and each query visits each block of rows. Either way a
task keeps the k best of its rows for a query, and only those are shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors up to which they are counted, collected and sent to all tasks.
QUERIES_AT_ONCE = 4096
#: Rows of a block that one task holds where the queries come by shuffle.
BLOCK_ROWS = 65_536


def usable(column: str = "embedding") -> Column:
    """A vector of finite numbers that are not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


class _Best:
    """The k best rows of some queries of one length, over batches of rows."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.d2, self.keys = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)

    def see(self, keys: np.ndarray, x: np.ndarray) -> None:
        d2 = np.empty((len(self.q), len(x)))
        for s in range(0, len(self.q), 64):  # exact differences, not the expanded square: ties must stay ties
            d2[s : s + 64] = ((self.q[s : s + 64, None, :] - x[None, :, :]) ** 2).sum(2)
        d2 = np.where(np.isnan(d2), np.inf, np.round(d2, 9))  # so that the order of summation decides no tie
        once, first = np.unique(keys, return_index=True)
        if len(once) < len(keys):  # an id's nearest vector stands for it
            order = np.argsort(keys, kind="stable")
            d2, keys = np.minimum.reduceat(d2[:, order], np.searchsorted(keys[order], once), axis=1), once
        d2, keys = np.hstack([self.d2, d2]), np.hstack([self.keys, np.broadcast_to(keys, (len(self.q), len(keys)))])
        # An id is there at most twice, held and new, so twice k are enough to keep k different ones.
        order = np.lexsort((keys, d2), axis=1)[:, : 2 * self.k]
        d2, keys = np.take_along_axis(d2, order, 1), np.take_along_axis(keys, order, 1)
        order = np.lexsort((d2, keys), axis=1)
        d2, keys = np.take_along_axis(d2, order, 1), np.take_along_axis(keys, order, 1)
        d2[:, 1:][keys[:, 1:] == keys[:, :-1]] = np.inf
        order = np.lexsort((keys, d2), axis=1)[:, : self.k]
        self.d2, self.keys = np.take_along_axis(d2, order, 1), np.take_along_axis(keys, order, 1)

    def found(self) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.repeat(self.ids, self.d2.shape[1]), "chunk_id": self.keys.ravel(), "d2": self.d2.ravel()})
        return out[np.isfinite(out.d2)]


_FOUND = "query_id long, chunk_id long, d2 double"


def _by_length(ids: list, embeddings: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list, list]] = {}
    for i, e in zip(ids, embeddings):
        held = out.setdefault(len(e), ([], []))
        held[0].append(i)
        held[1].append(e)
    return {n: (np.array(i, dtype=np.int64), np.array(e, dtype=np.float64)) for n, (i, e) in out.items()}


def _by_broadcast(rows: DataFrame, held: list, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_by_length([r.query_id for r in held], [r.embedding for r in held]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: _Best(ids, q, k) for n, (ids, q) in shared.value.items()}
        for batch in batches:
            for n, (keys, x) in _by_length(batch.chunk_id.tolist(), batch.embedding.tolist()).items():
                if n in best:
                    best[n].see(keys, x)
        for b in best.values():
            yield b.found()

    return rows.mapInPandas(search, _FOUND)


def _by_blocks(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
    entries = rows.select(block.alias("block"), F.lit(0).alias("kind"), F.col("chunk_id").alias("id"), "embedding")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "embedding")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, here = None, [], {}
        for batch in batches:
            for (block, kind), group in batch.groupby(["block", "kind"], sort=True):
                if block != at:
                    at, held, here = block, [], {}
                if kind == 0:
                    held.append((group.id.tolist(), group.embedding.tolist()))
                    continue
                if held:
                    here, held = _by_length([i for ids, _ in held for i in ids], [e for _, es in held for e in es]), []
                for n, (ids, q) in _by_length(group.id.tolist(), group.embedding.tolist()).items():
                    for s in range(0, len(ids) if n in here else 0, 256):
                        best = _Best(ids[s : s + 256], q[s : s + 256], k)
                        keys, x = here[n]
                        for t in range(0, len(keys), 8192):
                            best.see(keys[t : t + 8192], x[t : t + 8192])
                        yield best.found()

    return entries.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind").mapInPandas(search, _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest rows of each query: `query_id`, `chunk_id`, `d2`, `rank` (from 0), ties to the smaller id.

    `vectors(chunk_id, embedding)`, `queries(query_id, embedding)`. Null vectors and vectors of
    another length than the query's take no part; an id that occurs twice is found once. Fewer
    than k rows give fewer neighbours.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "embedding")
    held = asked.limit(QUERIES_AT_ONCE + 1).collect()
    found = _by_broadcast(rows, held, k) if len(held) <= QUERIES_AT_ONCE else _by_blocks(rows, asked, k)
    found = found.groupBy("query_id", "chunk_id").agg(F.min("d2").alias("d2"))
    order = Window.partitionBy("query_id").orderBy("d2", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def cut(found: DataFrame, below: float, first: int | None = None) -> DataFrame:
    """Hits nearer than `below`, taken after the top k; then the first so many of each query, ranked again."""
    near = found.where(F.col("d2") < below)
    order = Window.partitionBy("query_id").orderBy("d2", "chunk_id")
    near = near.withColumn("rank", F.row_number().over(order) - 1)
    return near if first is None else near.where(F.col("rank") < first)
