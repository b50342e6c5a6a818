"""The dependency graph of each project's files.

A module may name a file by the end of its path or by its stem, in several spellings; the first
spelling that any file answers to decides, and of the files the first. That is an OR of an
ends-with and an equality; instead of a nested loop every file offers its stem and the ends of its
path, as long as some spelling is, as keys. Of the files under a key only the first can be meant, so
files are reduced to it before both equi-joins: no key is hot.

In a graph of two sides the nodes two steps off are counted without listing the pairs, of which there may be many times
more than edges: see `two_steps`.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import stem, suffix
from quarry.operators.imports import SCRIPT_ENDINGS, file_imports
from quarry.plans.scratch import written

#: Nodes in the lists of a block that one task holds, about (2, 4 or 8 bytes each), and nodes reached that are sorted at a time.
BLOCK_NODES, REACHED_NODES = 2**25, 2**22
#: Spellings of a script import, in order.
SCRIPT_TRIES = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")


def _python_spellings(module: Column) -> tuple[Column, Column]:
    path, last = F.replace(module, F.lit("."), F.lit("/")), F.substring_index(module, ".", -1)
    return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(last, F.lit(".py"))), F.array(last, last, last)


def normal_path(path: Column) -> Column:
    """`.` and `..` steps of a relative path taken out; steps above the top vanish."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _script_spellings(source: Column, module: Column) -> tuple[Column, Column]:
    folder = F.regexp_extract(source, "^(.*)/[^/]*$", 1)
    base = F.when(F.startswith(module, F.lit(".")) & (folder != ""), normal_path(F.concat_ws("/", folder, module))).otherwise(module)
    tries = [F.concat(base, F.lit(t)) for t in SCRIPT_TRIES]
    return F.array(*tries), F.array(*[stem(t) for t in tries])


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Which file each import names: `project_id`, `src`, `module`, `dst`. Imports no file answers to give no row.

    `imports(project_id, path, module)`, `files(project_id, path, file_ord)`; only Python and
    script files' imports name files. Of the files that answer to a spelling the first by
    `file_ord` is taken, of the spellings the first that is answered.
    """
    asked = imports.select("project_id", F.col("path").alias("src"), "module").distinct()
    ending = F.lower(suffix("src"))
    python, script = asked.where(ending == ".py"), asked.where(ending.isin(*SCRIPT_ENDINGS))

    def spelled(part: DataFrame, spellings: tuple[Column, Column]) -> DataFrame:
        pairs = part.select("project_id", "src", "module", F.posexplode(F.arrays_zip(spellings[0].alias("end"), spellings[1].alias("stem"))).alias("try", "s"))
        return pairs.select("project_id", "src", "module", "try", F.col("s.end").alias("end"), F.col("s.stem").alias("stem"))

    tries = spelled(python, _python_spellings(F.col("module"))).unionByName(spelled(script, _script_spellings(F.col("src"), F.col("module"))))
    known = files.where("path is not null").select("project_id", F.col("path").alias("dst"), "file_ord")
    wanted = tries.select("project_id", "end").distinct()
    lengths = [r.n for r in wanted.select(F.length("end").alias("n")).distinct().collect()]  # no more than a path has characters

    def first_under(key: str, offered: DataFrame) -> DataFrame:
        return offered.groupBy("project_id", key).agg(F.min_by("dst", "file_ord").alias("dst"), F.min("file_ord").alias("file_ord"))

    cuts = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("dst"))
    ends = known.select("*", F.explode(F.transform(cuts, lambda n: F.right(F.col("dst"), n))).alias("end")).join(wanted, ["project_id", "end"], "left_semi")
    answered = ["project_id", "src", "module", "try", "dst", "file_ord"]
    by_end = tries.join(first_under("end", ends), ["project_id", "end"]).select(*answered)
    by_stem = tries.join(first_under("stem", known.withColumn("stem", stem("dst"))), ["project_id", "stem"]).select(*answered)
    answers = by_end.unionByName(by_stem)
    first = answers.groupBy("project_id", "src", "module").agg(F.min_by("dst", F.struct("try", "file_ord")).alias("dst"))
    return first


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges between different files: `project_id`, `src`, `dst`."""
    return resolve(imports, files).where("src <> dst").select("project_id", "src", "dst").distinct()


def neighbours(graph: DataFrame) -> DataFrame:
    """Both directions of each edge: `project_id`, `path`, `related`."""
    out = graph.select("project_id", F.col("src").alias("path"), F.col("dst").alias("related"))
    back = graph.select("project_id", F.col("dst").alias("path"), F.col("src").alias("related"))
    return out.unionByName(back).distinct()


def related(graph: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Files within `depth` steps of each start, either way, without the start: `project_id`, `path`, `related`, `steps`.

    One equi-join per step; what a start has seen is left out by an anti-join.
    """
    step = neighbours(graph)
    start = starts.select("project_id", "path").distinct()
    seen = start.select("project_id", "path", F.col("path").alias("related"), F.lit(0).alias("steps"))
    front = seen
    for d in range(1, depth + 1):
        reach = front.select("project_id", "path", F.col("related").alias("at")).join(step.select("project_id", F.col("path").alias("at"), "related"), ["project_id", "at"])
        front = reach.select("project_id", "path", "related").distinct().join(seen, ["project_id", "path", "related"], "left_anti").withColumn("steps", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("steps > 0")


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges sorted by (right, left) as (left nodes, where each right node's list begins), repeated edges once, no list cut."""
    rest = np.empty((2, 0), dtype=np.int64)
    for batch in batches:
        edges = np.concatenate([rest, batch[["right", "left"]].to_numpy(np.int64).T], axis=1)
        last = np.searchsorted(edges[0], edges[0][-1]) if edges.shape[1] else 0
        edges, rest = edges[:, :last], edges[:, last:]
        if last:
            yield _once(edges)
    if rest.shape[1]:
        yield _once(rest)


def _once(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right, left = edges[:, np.r_[True, (edges[:, 1:] != edges[:, :-1]).any(0)]]
    return left, np.flatnonzero(np.r_[True, right[1:] != right[:-1]])


def two_steps(edges: DataFrame) -> DataFrame:
    """How many nodes of a graph of two sides lie one and two steps from each left node: `left`, `steps`, `nodes` (none: no row).

    `edges(left long, right long)`, in any order, also repeated; rows with a null are left out. Each
    right node keeps the list of its left nodes. Left nodes are dealt to blocks, and a list is sent
    once to each block that has one of its nodes; there the lists of a node are put together and their
    different nodes counted. So what is shuffled grows with edges times blocks, not with pairs, and
    blocks are as many as keep a block's lists below about `BLOCK_NODES`.
    """
    spark = edges.sparkSession
    known = edges.where("left is not null and right is not null").select("left", "right")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for left, begins in _lists(batches):
            sizes, counts = np.unique(np.diff(np.r_[begins, len(left)]), return_counts=True)
            yield pd.DataFrame({"left": [left.tobytes()], "begins": [begins.tobytes()], "least": [left.min()], "most": [left.max()], "sizes": [sizes.tolist()], "counts": [counts.tolist()]})

    by_right = known.repartition("right").sortWithinPartitions("right", "left")
    lists = written(by_right.mapInPandas(gathered, "left binary, begins binary, least long, most long, sizes array<long>, counts array<long>"), "lists")
    span = lists.agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()[0]
    if span.least is None:
        return spark.createDataFrame([], "left long, steps int, nodes long")
    sizes = lists.select(F.explode(F.arrays_zip("sizes", "counts")).alias("x")).groupBy("x.sizes").agg(F.sum("x.counts").alias("n")).toPandas()  # fewer than the root of twice the edges
    size, n = sizes.sizes.to_numpy(np.float64), sizes.n.to_numpy(np.float64)
    least, dtype = int(span.least), np.min_scalar_type(int(span.most) - int(span.least))
    blocks = 2 * max(1, spark.sparkContext.defaultParallelism)
    while (n * size * (1 - (1 - 1 / blocks) ** size)).sum() > BLOCK_NODES and blocks < n @ size:
        blocks *= 2

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for nodes, begins in zip(batch.left, batch.begins):
                left, begins = (np.frombuffer(nodes, np.int64).view(np.uint64) - np.uint64(least % 2**64)).astype(dtype), np.frombuffer(begins, np.int64)
                lengths = np.diff(np.r_[begins, len(left)])
                of = np.repeat(np.arange(len(begins)), lengths)
                block = ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)
                order = np.argsort(block, kind="stable")
                out = []
                for b, mine in zip(np.unique(block), np.split(order, np.flatnonzero(np.diff(block[order])) + 1)):
                    met, at = np.unique(of[mine], return_inverse=True)  # its lists, and which of them each start is in
                    here = np.repeat(begins[met] - np.r_[0, np.cumsum(lengths[met])[:-1]], lengths[met]) + np.arange(lengths[met].sum())
                    out.append((int(b), left[mine].tobytes(), at.astype(np.uint32).tobytes(), left[here].tobytes(), lengths[met].astype(np.uint32).tobytes()))
                yield pd.DataFrame(out, columns=["block", "start", "at", "nodes", "lengths"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and row.block != at:
                    yield from _counted(held, dtype, least)
                    held = []
                at = row.block
                held.append(row)
        if held:
            yield from _counted(held, dtype, least)

    sent = lists.select("left", "begins").mapInPandas(routed, "block int, start binary, at binary, nodes binary, lengths binary")
    return sent.repartitionById(blocks, F.col("block")).sortWithinPartitions("block").mapInPandas(counted, "left long, steps int, nodes long")


def _counted(rows: list, dtype: np.dtype, least: int) -> Iterator[pd.DataFrame]:
    """One block: for each start how many lists it is in (one step) and how many other nodes these hold (two steps)."""
    lengths = [np.frombuffer(r.lengths, np.uint32) for r in rows]
    first = np.r_[0, np.cumsum([len(x) for x in lengths])]
    start = np.concatenate([np.frombuffer(r.start, dtype) for r in rows])
    at = np.concatenate([np.frombuffer(r.at, np.uint32).astype(np.int64) + f for r, f in zip(rows, first)])
    nodes, lengths = np.concatenate([np.frombuffer(r.nodes, dtype) for r in rows]), np.concatenate(lengths).astype(np.int64)
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(start, kind="stable")
    start, at = start[order], at[order]
    edge = np.r_[np.flatnonzero(np.r_[True, start[1:] != start[:-1]]), len(start)]
    two = np.empty(len(edge) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        upto = np.cumsum(lengths[at[a:b]])
        seen = nodes[:0]
        # As many lists at a time as hold about REACHED_NODES.
        cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(REACHED_NODES, upto[-1], REACHED_NODES), side="right"), b - a])
        for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine, many = at[a + c : a + d], lengths[at[a + c : a + d]]
            ends = np.cumsum(many)
            reached = nodes[np.repeat(begins[mine] - ends + many, many) + np.arange(ends[-1])]
            reached = np.sort(np.concatenate([seen, reached]) if len(seen) else reached)
            seen = reached[np.r_[True, reached[1:] != reached[:-1]]]
        two[i] = len(seen) - 1  # without itself
    left = (start[edge[:-1]].astype(np.uint64) + np.uint64(least % 2**64)).view(np.int64)
    for steps, n in ((1, np.diff(edge)), (2, two)):
        yield pd.DataFrame({"left": left[n > 0], "steps": steps, "nodes": n[n > 0]}).astype({"steps": "int32"})


def export(files: DataFrame, imports: DataFrame, graph: DataFrame) -> DataFrame:
    """A node per file: `project_id`, `path`, `name`, `imports` (in order), `dependencies`, `dependents` (sorted)."""
    ordered = imports.groupBy("project_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "module"))), lambda x: x.module).alias("imports"))
    out = graph.groupBy("project_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    back = graph.groupBy("project_id", F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    nodes = files.select("project_id", "path", F.substring_index("path", "/", -1).alias("name")).distinct()
    for part in (ordered, out, back):
        nodes = nodes.join(part, ["project_id", "path"], "left")
    none = F.array().cast("array<string>")
    return nodes.select("project_id", "path", "name", *[F.coalesce(c, none).alias(c) for c in ("imports", "dependencies", "dependents")])


def totals(files: DataFrame, graph: DataFrame) -> DataFrame:
    """`project_id`, `total_files`, `total_edges`."""
    n = files.groupBy("project_id").agg(F.count_distinct("path").alias("total_files"))
    m = graph.groupBy("project_id").agg(F.count("*").alias("total_edges"))
    return n.join(m, "project_id", "left").select("project_id", "total_files", F.coalesce("total_edges", F.lit(0)).alias("total_edges"))


def expand(hits: DataFrame, chunks: DataFrame, graph: DataFrame, most: int = 2) -> DataFrame:
    """Chunks of files next to the hit files: `query_id`, `chunk_id`, `path`, `rank` (from 0).

    `hits(query_id, project_id, path)`; of each related file that no hit is in, the chunk with the
    smallest id; of these the `most` smallest.
    """
    hit = hits.select("query_id", "project_id", "path").distinct()
    near = hit.join(neighbours(graph), ["project_id", "path"]).select("query_id", "project_id", F.col("related").alias("path")).distinct()
    near = near.join(hit, ["query_id", "project_id", "path"], "left_anti")
    first = chunks.groupBy("project_id", "path").agg(F.min("chunk_id").alias("chunk_id"))
    found = near.join(first, ["project_id", "path"])
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most).select("query_id", "chunk_id", "path", "rank")


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, edges) of `files(project_id, path, file_name, content, file_ord)`."""
    found = written(file_imports(files), "imports")  # parsed once, read by both
    return found, edges(found, files)
