"""Problem 1: the most similar vectors of every vector, by an inverted multi-index.

Each vector is cut into two halves and each half quantised by its own codebook of `K` centroids,
so a vector belongs to one of K*K cells. For ten neighbours a query walks the cells in the order
of its summed distance to the two centroids (a heap over the two sorted lists) until the cells
visited hold at least `candidates` vectors; the sum reached is its radius. For pairs above a
threshold it visits the cells of which both halves lie within `reach`. Only the entries of visited
cells are compared with it.

Scale: codebooks are fitted on a bounded sample, every vector is indexed, and K grows with the
square root of the rows. Neighbouring rows of cells form a block of at most about `BLOCK_ROWS`
entries; a query is sent once to each block with a cell to visit and finds the cells there by its
radius. A row of cells over that bound is split by salt. A task holds one block's entries; queries
stream past them. Exact copies are collapsed before the search and come back through the membership
table, in slices where a group of them is large.
"""

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.scratch import written

DIM = 64
HALF = DIM // 2
#: Vectors on which the codebooks are fitted, at most about so many.
SAMPLE_ROWS = 20_000
#: Centroids of a codebook: the square root of the vectors times this, rounded up to a power of two; the sample bounds them.
CENTROIDS, MOST_CENTROIDS = 0.25, 4096
#: Entries of a block, about, that one task holds.
BLOCK_ROWS = 262_144
#: Blocks there are at least, where there are rows enough, so that small tables use several tasks.
LEAST_BLOCKS = 4
#: Queries compared at a time.
QUERY_ROWS = 16_384
#: Times the standard deviation, along one direction, of the step between two vectors at the threshold: how far beyond a cell's border a query looks.
REACH = 1.8
#: Candidates at which the walk over cells ends, at least.
LEAST_CANDIDATES = 50
#: The part of a sample's true neighbours that the walk must reach; the share of the entries it needs for that ends the walk, at every size.
WANTED, WANTED_QUERIES = 0.93, 256
#: Runs into which the walk cuts a row of cells; a step takes one.
RUNS = 16
#: What half precision may change in a summed distance.
SLACK = 2e-3
#: Members of a group of copies that meet those of another in one task.
SLICE_ROWS = 1000


def usable(column: str = "embedding"):
    """64 finite numbers, not all zero. Null, shorter, longer, NaN and infinite vectors are not usable."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == DIM) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def keyed(vectors: DataFrame) -> DataFrame:
    """Usable rows as `chunk_id`, `k1`, `k2` (equal for equal vectors: 96 bits, below 1e-10 for any collision among a billion) and `embedding`."""
    rows = vectors.select("chunk_id", "embedding").where(F.col("chunk_id").isNotNull() & usable())
    return rows.select("chunk_id", F.xxhash64("embedding").alias("k1"), F.hash("embedding").alias("k2"), "embedding")


def collapsed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each different vector once (`vid`, `embedding`); `chunk_id`, `vid`, `slice` of all rows; `vid`, `size`, `slices` of vectors with copies."""
    once = written(rows.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("rows")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    members = rows.select("chunk_id", "k1", "k2").distinct().join(once.select("k1", "k2", "vid", "rows"), ["k1", "k2"])
    slices = F.ceil(F.col("rows") / SLICE_ROWS).cast("int")
    members = members.select("chunk_id", "vid", F.when(F.col("rows") <= SLICE_ROWS, 0).otherwise(F.pmod(F.xxhash64("chunk_id"), slices).cast("int")).alias("slice"))
    return once.select("vid", "embedding"), members, once.where("rows > 1").select("vid", slices.alias("slices"))


def _unit(embedding: pd.Series) -> np.ndarray:
    x = np.stack(embedding.to_numpy()).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centroid, without the row's own norm (it does not change the order)."""
    return (centroids * centroids).sum(1)[None, :] - 2.0 * (x @ centroids.T)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids.astype(np.float32)


class MultiIndex:
    """Codebooks, cell sizes and block layout: all of bounded size (K <= MOST_CENTROIDS)."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        # Rows of cells side by side in a block are near each other: along the direction in which their centroids differ most.
        self.first = first[np.argsort((first - first.mean(0)) @ np.linalg.svd(first - first.mean(0), full_matrices=False)[2][0])]
        self.second, self.k = second, len(first)
        self.sizes, self.share = np.zeros((self.k, self.k), dtype=np.int32), 1.0
        self.lay_out()

    def lay_out(self) -> None:
        """Blocks of rows of cells: `block` of each row, `salts` of each block."""
        rows = self.sizes.sum(1, dtype=np.int64)
        most = min(BLOCK_ROWS, max(1, -(-int(rows.sum()) // LEAST_BLOCKS)))
        self.block, at, held = np.zeros(self.k, dtype=np.int64), 0, 0
        for i, n in enumerate(rows.tolist()):
            if held and held + n > 1.1 * most:
                at, held = at + 1, 0
            self.block[i] = at
            held += n
        self.blocks = at + 1
        self.salts = np.maximum(1, -(-np.bincount(self.block, weights=rows, minlength=self.blocks).astype(np.int64) // BLOCK_ROWS))
        self.begins = np.searchsorted(self.block, np.arange(self.blocks + 1))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, :HALF], self.first), _distances(x[:, HALF:], self.second)

    def near(self, d: np.ndarray, centroids: np.ndarray, reach: float) -> np.ndarray:
        """For each query and centroid whether the border with the query's own centroid is within `reach`.

        Each of a pair looks for the other: it is missed only if both lie further than `reach` from
        a border between their cells, so that the step between them crosses it by over twice that.
        """
        home = d.argmin(1)
        apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(-1))
        return d - d[np.arange(len(d)), home][:, None] <= 2 * reach * apart[home]

    def radius(self, d1: np.ndarray, d2: np.ndarray, candidates: int) -> np.ndarray:
        """For each query the summed distance of the last cell the walk visits before it holds `candidates` entries."""
        order1, order2, k = d1.argsort(1), d2.argsort(1), self.k
        run = max(1, k // RUNS)
        sorted1, sorted2 = np.take_along_axis(d1, order1, 1).tolist(), np.take_along_axis(d2, order2, 1).tolist()
        out = np.empty(len(d1), dtype=np.float32)
        for r, (a, b, o1) in enumerate(zip(sorted1, sorted2, order1.tolist())):
            held = self.sizes[:, order2[r]].reshape(k, -1, run).sum(2).tolist()  # entries of runs of cells in a row, by the query's own order
            heap, found, s = [(a[0] + b[0], 0, 0)], 0, 0.0
            while heap and found < candidates:
                s, i, j = heapq.heappop(heap)
                found += held[o1[i]][j]
                if (j + 1) * run < k:
                    heapq.heappush(heap, (a[i] + b[(j + 1) * run], i, j + 1))
                if j == 0 and i + 1 < k:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            out[r] = s if heap else np.inf
        return out


def needed_share(index: MultiIndex, x: np.ndarray, k: int) -> float:
    """The share of all entries that the walks of some of the sampled vectors `x` must see to reach WANTED of their k nearest among `x`.

    A sample is thinner than all rows and its neighbours lie further off, so the share errs to the safe side.
    """
    total, needs = index.sizes.sum(dtype=np.int64), []
    d1, d2 = index.halves(x)
    cell = d1.argmin(1), d2.argmin(1)
    for q in np.linspace(0, len(x) - 1, min(len(x), WANTED_QUERIES if index.k <= 512 else WANTED_QUERIES // 8)).astype(int):
        cos = x @ x[q]
        cos[q] = -2
        sums = d1[q][:, None] + d2[q][None, :]
        order = sums.ravel().argsort()
        upto = np.cumsum(index.sizes.ravel()[order], dtype=np.int64)
        at = np.searchsorted(sums.ravel()[order], [sums[cell[0][m], cell[1][m]] for m in np.argsort(-cos)[:k]], side="right") - 1
        needs += (upto[at] / total).tolist()
    return float(np.quantile(needs, WANTED)) if needs else 1.0


def fit(rows: DataFrame, neighbours: int | None = None) -> MultiIndex | None:
    """Codebooks from a bounded sample and the cell sizes of all rows (one for each vector); None when there is no row.

    With `neighbours` the index knows the `share` of the entries that a walk for so many must see.
    """
    n = rows.count()
    if n == 0:
        return None
    k = int(min(MOST_CENTROIDS, max(4, 2 ** math.ceil(math.log2(CENTROIDS * math.sqrt(n))))))
    every = max(1, n // SAMPLE_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("vid"), F.lit(every)) == 0).select("embedding").limit(2 * SAMPLE_ROWS).toPandas()
    if len(sample) < 4:
        sample = rows.select("embedding").limit(1000).toPandas()
    x = _unit(sample.embedding)
    index = MultiIndex(_kmeans(x[:, :HALF], k), _kmeans(x[:, HALF:], k))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            if len(batch):
                d1, d2 = index.halves(_unit(batch.embedding))
                sums += np.bincount(d1.argmin(1) * k + d2.argmin(1), minlength=k * k)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": at, "n": sums[at]})

    counts = rows.select("embedding").mapInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    index.sizes.reshape(-1)[counts.cell.to_numpy()] = counts.n.to_numpy()
    index.lay_out()
    if neighbours:
        index.share = needed_share(index, x, neighbours)
    return index


Visits = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _parts(rows: DataFrame, index: MultiIndex) -> int:
    """A block's queries are dealt to so many tasks, each with all its entries, that all cores have some."""
    return -(-2 * max(1, rows.sparkSession.sparkContext.defaultParallelism) // index.blocks)


def _routed(rows: DataFrame, index: MultiIndex, reaches: Visits) -> DataFrame:
    """Entries (kind 0, in their own block) and queries (kind 1, once per block with a cell to visit), both in half precision.

    `reaches` gives for queries the least summed distance in each row of cells that is visited
    (rows x K, infinite where none is) and their radius.
    """
    parts = _parts(rows, index)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s in range(0, len(whole), 4096):
                batch = whole.iloc[s : s + 4096]
                x, ids = _unit(batch.embedding), batch.vid.to_numpy()
                d1, d2 = index.halves(x)
                home = d1.argmin(1)
                cell, block = (home * index.k + d2.argmin(1)).astype(np.int32), index.block[home]
                half = np.array([v.tobytes() for v in x.astype(np.float16)], dtype=object)
                every = np.arange(parts)
                yield pd.DataFrame({"block": np.repeat(block, parts), "salt": np.repeat(ids % index.salts[block], parts), "part": np.tile(every, len(ids)), "kind": 0, "cell": np.repeat(cell, parts), "vid": np.repeat(ids, parts), "radius": np.float32(0), "v": np.repeat(half, parts)})
                least, radius = reaches(d1, d2)
                row, to = np.nonzero(np.minimum.reduceat(least, index.begins[:-1], axis=1) < np.inf)
                times = index.salts[to]
                row, to = np.repeat(row, times), np.repeat(to, times)
                salt = np.concatenate([np.arange(t) for t in times]) if len(times) else times
                yield pd.DataFrame({"block": to, "salt": salt, "part": ids[row] % parts, "kind": 1, "cell": cell[row], "vid": ids[row], "radius": radius[row], "v": half[row]})

    return rows.select("vid", "embedding").mapInPandas(route, "block int, salt int, part int, kind int, cell int, vid long, radius float, v binary")


def _by_block(routed: DataFrame, index: MultiIndex) -> DataFrame:
    # One task for each part of a block: numbered one after the other, so that no two fall together by their hash.
    parts = _parts(routed, index)
    first = np.concatenate([[0], np.cumsum(index.salts)])
    slot = (F.element_at(F.lit(first[:-1].tolist()).cast("array<int>"), F.col("block") + 1) + F.col("salt")) * parts + F.col("part")
    return routed.repartitionById(int(first[-1]) * parts, slot.cast("int")).sortWithinPartitions("block", "salt", "part", "kind", "cell")


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=np.float16).reshape(-1, DIM).astype(np.float32)


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows as (block, its entries (cell, id, vector) by cell, query ids, radii, query matrix), up to QUERY_ROWS queries at a time."""
    at, held, entries, queries, waiting = None, [], None, [], 0

    def asked() -> Iterator[tuple]:
        if queries and entries is not None:
            q = pd.concat(queries)
            for s in range(0, len(q), QUERY_ROWS):
                part = q.iloc[s : s + QUERY_ROWS]
                yield at[0], entries, part.vid.to_numpy(), part.radius.to_numpy(), _matrix(part.v)

    for batch in batches:
        for key, group in batch.groupby(["block", "salt", "part", "kind"], sort=True):
            if at != key[:3]:
                yield from asked()
                at, held, entries, queries, waiting = key[:3], [], None, [], 0
            if key[3] == 0:
                held.append((group.cell.to_numpy(), group.vid.to_numpy(), _matrix(group.v)))
                continue
            if entries is None and held:
                entries, held = tuple(np.concatenate(x) for x in zip(*held)), []
            queries.append(group)
            waiting += len(group)
            if waiting >= QUERY_ROWS:
                yield from asked()
                queries, waiting = [], 0
    yield from asked()


def _compared(index: MultiIndex, visits: Iterator[tuple], may: Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[int], tuple[np.ndarray, np.ndarray]]], least: float, k: int | None) -> Iterator[tuple]:
    """(query ids, entry ids, cosines) of the entries of visited cells, above `least`; with `k` only each query's best k in the block."""
    for block, (cells, ids, x), asked, radius, q in visits:
        d1, d2 = index.halves(q)
        inside = may(d1, d2, radius)
        starts = np.searchsorted(cells, np.arange(index.begins[block] * index.k, index.begins[block + 1] * index.k + 1))
        floor = np.full(len(q), least, dtype=np.float32)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def kept(hits: list, floor: np.ndarray = floor) -> list:
            r, c, s = (np.concatenate(h) for h in zip(*hits))
            order = np.lexsort((-s, r))
            r, c, s = r[order], c[order], s[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            full = rank == k - 1
            floor[r[full]] = s[full]
            return [(r[rank < k], c[rank < k], s[rank < k])]

        waiting = 0
        # The nearest rows of cells first: they raise the floor for the others.
        for i in d1[:, index.begins[block] : index.begins[block + 1]].mean(0).argsort().tolist():
            at = starts[i * index.k : (i + 1) * index.k + 1]
            if at[0] == at[-1]:
                continue
            near, visit = inside(int(index.begins[block]) + i)  # queries that visit a cell of the row, K x these
            for j in np.flatnonzero((at[1:] > at[:-1]) & visit.any(1)).tolist():
                rows = near[visit[j]]
                cos = q[rows] @ x[at[j] : at[j + 1]].T
                r, c = np.nonzero(cos > floor[rows][:, None])
                if len(r):
                    hits.append((rows[r], c + at[j], cos[r, c]))
                    waiting += len(r)
            if k and waiting > 40 * len(q):
                hits, waiting = kept(hits), 0
        if hits:
            for r, c, s in kept(hits) if k else hits:
                yield asked[r], ids[c], s


def similar_keys(rows: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """Range mode: distinct pairs `ka` < `kb` of different vectors with cosine >= threshold, and the cosine."""
    reach = REACH * math.sqrt(max(0.0, 2 - 2 * threshold) / DIM)

    def reaches(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(index.near(d1, index.first, reach), 0.0, np.inf), np.zeros(len(d1), dtype=np.float32)

    def may(d1: np.ndarray, d2: np.ndarray, radius: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        near1, near2 = np.ascontiguousarray(index.near(d1, index.first, reach).T), np.ascontiguousarray(index.near(d2, index.second, reach).T)

        def inside(i: int) -> tuple[np.ndarray, np.ndarray]:
            near = np.flatnonzero(near1[i])
            return near, near2.take(near, axis=1)

        return inside

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, cos in _compared(index, _visits(batches), may, threshold - 5e-4, None):
            keep = a != b
            yield pd.DataFrame({"ka": np.minimum(a, b)[keep], "kb": np.maximum(a, b)[keep], "cos": cos[keep].astype(np.float64)})

    found = _by_block(_routed(rows, index, reaches), index).mapInPandas(search, "ka long, kb long, cos double")
    return found.groupBy("ka", "kb").agg(F.max("cos").alias("cos"))


def nearest_keys(rows: DataFrame, index: MultiIndex, k: int, candidates: int) -> DataFrame:
    """Top-k mode: for each vector `ka` its k most similar other vectors `kb` with the cosine."""

    def reaches(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = index.radius(d1, d2, candidates)
        least = d1 + d2.min(1)[:, None]
        return np.where(least <= radius[:, None] + SLACK, least, np.inf), radius

    def may(d1: np.ndarray, d2: np.ndarray, radius: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        by_second, least = np.ascontiguousarray(d2.T), d2.min(1)

        def inside(i: int) -> tuple[np.ndarray, np.ndarray]:
            left = radius + SLACK - d1[:, i]
            near = np.flatnonzero(least <= left)
            return near, by_second.take(near, axis=1) <= left[near][None, :]

        return inside

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, cos in _compared(index, _visits(batches), may, -2.0, k + 1):
            keep = a != b
            yield pd.DataFrame({"ka": a[keep], "kb": b[keep], "cos": cos[keep].astype(np.float64)})

    found = _by_block(_routed(rows, index, reaches), index).mapInPandas(search, "ka long, kb long, cos double")
    best = F.slice(F.sort_array(F.collect_set(F.struct("cos", "kb")), asc=False), 1, k)
    # A task yields at most k + 1 rows for a query, so the sets are bounded by the blocks.
    return found.groupBy("ka").agg(best.alias("best")).select("ka", F.inline("best")).select("ka", "kb", "cos")


def _slices(vid: str, large: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` with `large.slices` of the vector `vid`, 1 where it is not large."""
    return pairs.join(large.select(F.col("vid").alias(vid), F.col("slices").alias(f"{vid}_slices")), vid, "left").withColumn(f"{vid}_slices", F.coalesce(f"{vid}_slices", F.lit(1)))


def _each_slice(slices: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(slices) - 1))


def similar_pairs(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of different chunks with cosine >= threshold: `chunk_id_a` < `chunk_id_b`, `cosine`.

    Rows with an unusable vector or a null id take no part; repeated rows count once; an id with
    several vectors pairs through each of them. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "chunk_id_a long, chunk_id_b long, cosine double"
    once, members, copies = collapsed(keyed(vectors))
    index = fit(once)
    if index is None:
        return spark.createDataFrame([], schema)
    members, large = written(members, "members"), copies.where("slices > 1")
    keys = similar_keys(once, index, threshold).unionByName(copies.select(F.col("vid").alias("ka"), F.col("vid").alias("kb"), F.lit(1.0).alias("cos")))
    # A group of copies meets another slice by slice, so that no task holds a large group.
    cut = _slices("kb", large, _slices("ka", large, keys)).select("ka", "kb", "cos", _each_slice("ka_slices").alias("sa"), "kb_slices")
    cut = cut.select("ka", "kb", "cos", "sa", _each_slice("kb_slices").alias("sb"))
    a = members.select(F.col("chunk_id").alias("a"), F.col("vid").alias("ka"), F.col("slice").alias("sa"))
    b = members.select(F.col("chunk_id").alias("b"), F.col("vid").alias("kb"), F.col("slice").alias("sb"))
    pairs = cut.join(a, ["ka", "sa"]).join(b, ["kb", "sb"]).where("a <> b and (ka <> kb or a < b)").select("a", "b", "cos")
    return pairs.groupBy(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).agg(F.max("cos").alias("cosine"))


def similar_chunks(vectors: DataFrame, k: int = 10) -> DataFrame:
    """For every chunk its k most similar other chunks: `chunk_id`, `rank`, `neighbour_id`, `cosine` (to about 0.0005).

    Ties go to the smaller id. Copies of a chunk come first; of each group of copies only the k + 1
    smallest ids can be among anyone's best k, so no more are expanded.
    """
    spark = vectors.sparkSession
    once, members, copies = collapsed(keyed(vectors))
    index = fit(once, k)
    if index is None:
        return spark.createDataFrame([], "chunk_id long, rank int, neighbour_id long, cosine double")
    members = written(members, "members")
    sliced = members.groupBy("vid", "slice").agg(F.slice(F.sort_array(F.collect_set("chunk_id")), 1, k + 1).alias("ids"))
    first = sliced.groupBy("vid").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    first = written(first, "first")
    keys = nearest_keys(once, index, k, max(LEAST_CANDIDATES, math.ceil(index.share * index.sizes.sum(dtype=np.int64))))
    own = first.select(F.col("vid").alias("ka"), F.explode("ids").alias("id"), F.lit(1.0).alias("cos"))
    others = keys.join(first.select(F.col("vid").alias("kb"), "ids"), "kb").select("ka", F.explode("ids").alias("id"), "cos")
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("far"), "id")))
    pool = own.unionByName(others).groupBy("ka").agg(F.slice(ranked, 1, 3 * k).alias("pool"))
    pool = _slices("vid", copies.where("slices > 1"), pool.withColumnRenamed("ka", "vid")).select("vid", "pool", _each_slice("vid_slices").alias("slice"))
    listed = members.join(pool, ["vid", "slice"]).select("chunk_id", F.slice(F.filter("pool", lambda p: p.id != F.col("chunk_id")), 1, k).alias("best"))
    out = listed.select("chunk_id", F.posexplode("best").alias("pos", "hit"))
    return out.select("chunk_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("neighbour_id"), (-F.col("hit.far")).alias("cosine"))
