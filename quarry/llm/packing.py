"""Problem 8: documents packed into containers of fixed capacity by minimum bin slack.

Only how many documents have each size matters for a plan, and there are no more sizes than the
capacity. So the plan is made on the driver from that bounded histogram: the largest size left
opens a container, a bitset subset-sum over the sizes left (with their counts, split in powers of
two) finds what fills the rest best, and that pattern is repeated while the counts allow.
Executors then rank the documents of each size, in groups of bounded size, and look their place up.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.scratch import written

CAPACITY = 2048
#: Documents of one size that are ranked in one group; a frequent size (that of full parts above all) has as many groups as it needs.
RANKED_ROWS = 50_000
#: A token: a longest run of letters, digits and underscores of any script, or one other visible character.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]"


def _fill(room: int, counts: np.ndarray) -> dict[int, int]:
    """The multiset of sizes left that fills `room` best: size -> times."""
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach, steps = 1, []
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, times = min(int(counts[size]), room // size), 1
        while left:
            take = min(times, left)
            after = (reach | reach << (size * take)) & mask
            if after != reach:
                steps.append((size, take, reach))
                reach = after
            left -= take
            times *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Intervals (size, first rank, times in a container, first container) and the number of containers.

    The ranks from one interval's first to the next one's fill containers one after the other.
    """
    counts = counts.copy()
    placed = np.zeros_like(counts)
    out, containers = [], 0
    for size in range(capacity, 0, -1):
        while counts[size]:
            counts[size] -= 1
            used = _fill(capacity - size, counts)
            counts[size] += 1
            used[size] = used.get(size, 0) + 1
            repeat = min(int(counts[s]) // n for s, n in used.items())
            for s, n in used.items():
                out.append((s, int(placed[s]), n, containers))
                placed[s] += repeat * n
                counts[s] -= repeat * n
            containers += repeat
    return out, containers


def sized(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each document's parts: `doc_id`, `part` (from 0), `tokens` (of the part), `parts`. Null text has 0 tokens; rows without id are left out."""
    tokens = documents.where("doc_id is not null").select("doc_id", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    cut = tokens.select("doc_id", "n", parts.alias("parts")).select("doc_id", "n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return cut.select("doc_id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("tokens"), "parts")


def packed(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All parts in containers: `container_id`, `doc_id`, `part`, `tokens`.

    A document is cut, every `capacity` tokens, only when it alone is larger. Documents without
    tokens take no room and are spread over the containers (container 0 if there is none).
    """
    spark = documents.sparkSession
    items = written(sized(documents, capacity).select("doc_id", "part", "tokens"), "sizes")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("tokens").count().collect():  # at most capacity + 1 rows
        counts[r.tokens] = r["count"]
    zero, counts[0] = int(counts[0]), 0
    intervals, containers = plan(counts, capacity)
    by_size: dict[int, tuple[list, list, list]] = {}
    for size, first, times, container in intervals:
        for held, value in zip(by_size.setdefault(size, ([], [], [])), (first, times, container)):
            held.append(value)
    lookup = spark.sparkContext.broadcast({s: tuple(np.array(x) for x in v) for s, v in by_size.items()})
    sizes = counts.copy()
    sizes[0] = zero
    groups = F.element_at(F.lit(np.maximum(1, -(-sizes // RANKED_ROWS)).tolist()).cast("array<int>"), F.col("tokens") + 1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), groups))
    offsets = salted.groupBy("tokens", "salt").agg(F.count("*").alias("n"))  # at most capacity + 1 + rows / RANKED_ROWS rows
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["tokens", "salt"]).select("doc_id", "part", "tokens", (F.col("offset") + F.col("within")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lookup.value
        for batch in batches:
            container = np.zeros(len(batch), dtype=np.int64)
            for size, at in batch.groupby("tokens").indices.items():
                ranks = batch["rank"].to_numpy()[at]
                if size == 0:
                    container[at] = ranks % max(1, containers)
                    continue
                first, times, base = known[size]
                k = np.searchsorted(first, ranks, side="right") - 1
                container[at] = base[k] + (ranks - first[k]) // times[k]
            yield batch[["doc_id", "part", "tokens"]].assign(container_id=container)[["container_id", "doc_id", "part", "tokens"]]

    return ranked.mapInPandas(place, "container_id long, doc_id long, part int, tokens int")


def oversized(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents that alone are larger than a container: `doc_id`, `tokens`."""
    return sized(documents, capacity).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("parts").alias("parts")).where("parts > 1").select("doc_id", "tokens")
