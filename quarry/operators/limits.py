"""Rate limits and caches replayed over logs.

Whether an event is admitted depends on the events admitted before it, so each key's log is read
in order. It is sorted by the shuffle and streams through a state of fixed size (the admitted
times of one window, or the entries of one cache): no task ever holds a key's log. What a cache
without a time limit holds at any moment are the keys used last, whatever was hit before; so its log
is cut into stretches that are replayed side by side, each from the keys used last before it.
"""

import itertools
import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.plans.scratch import written


class SlidingWindow:
    """At most `limit` events are admitted in any `window` seconds; refused ones do not count.

    An event is admitted if the admission `limit` places back is at least a window old: only so many
    times are kept, in a ring.
    """

    def __init__(self, limit: int, window: float = 60.0, times: Iterable[float] = ()):
        self.limit, self.window = limit, window
        self.ring = deque(times, maxlen=max(limit, 0))

    def allow(self, now: float) -> bool:
        free = len(self.ring) < self.limit or self.limit > 0 and now - self.ring[0] >= self.window
        if free:
            self.ring.append(now)
        return free


class Lru:
    """A cache of the `size` keys used last, each until `ttl` seconds after it was put; a hit does not renew it. A get that misses is followed by a put."""

    def __init__(self, size: int = 2048, ttl: float = math.inf):
        self.size, self.ttl = size, ttl
        self.put_at: dict[object, float] = {}  # in the order of use: the first is the one to go

    def access(self, key: object, now: float = 0.0) -> bool:
        put = self.put_at.pop(key, None)
        hit = put is not None and now - put < self.ttl
        self.put_at[key] = put if hit else now
        for oldest in list(itertools.islice(self.put_at, max(0, len(self.put_at) - self.size))):
            del self.put_at[oldest]
        return hit


def _replay(log: DataFrame, scope: str, time: str, tie: str, start: Callable[[], Callable[[object, float], bool]], key: str | None, flag: str, clear: str | None = None) -> DataFrame:
    """`log` with `flag`, each scope's rows in the order of (time, tie). Rows without scope or time are left out.

    Where the column `clear` is true, the scope starts anew and the row itself is no access.
    """
    columns = list(dict.fromkeys([scope, time, tie, *([key] if key else []), *([clear] if clear else [])]))
    rows = log.where(F.col(scope).isNotNull() & F.col(time).isNotNull()).select(*columns, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    rows = rows.repartition(scope).sortWithinPartitions(scope, time, tie)
    schema = rows.drop("_t").schema.add(flag, "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for batch in batches:
            out = []
            keys = batch[key] if key else batch[scope]
            cleared = batch[clear] if clear else [False] * len(batch)
            for s, k, t, c in zip(batch[scope], keys, batch["_t"], cleared):
                if s != at or c:
                    at, step = s, start()
                out.append(not c and step(k, t / 1e6))
            yield batch[columns].assign(**{flag: np.array(out, dtype=bool)})

    return rows.mapInPandas(run, schema)


def rate_limited(events: DataFrame, scope: str = "user_id", time: str = "ts", tie: str = "event_id", limit: int = 10, window: float = 60.0) -> DataFrame:
    """Events with `allowed`: each scope has its own window."""
    return _replay(events, scope, time, tie, lambda: (lambda w: lambda _, t: w.allow(t))(SlidingWindow(limit, window)), None, "allowed")


def _flagged(rows: DataFrame, flag: str) -> StructType:
    return StructType([*rows.schema.fields, StructField(flag, BooleanType())])


def _keys(values: pd.Series) -> list:
    return [None if k is None or k != k else k for k in values]


def _last_used(size: int, names: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of the first and the last scope of each stretch the keys used last (`rank` from the oldest on), and whether the cache was emptied."""
    columns = [names["scope"], "_part", "_rank", names["key"], "_emptied"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, cache, emptied, scopes = None, None, Lru(size), False, 0

        def told() -> pd.DataFrame:
            rows = [(at, part, n, k, emptied) for n, k in enumerate(cache.put_at)] or [(at, part, -1, None, emptied)]
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            for s, k, p, c in zip(batch[names["scope"]], _keys(batch[names["key"]]), batch["_part"], batch["_clear"]):
                if not scopes or s != at:
                    if scopes == 1:
                        yield told()
                    at, part, cache, emptied, scopes = s, p, Lru(size), False, scopes + 1
                if c:
                    cache, emptied = Lru(size), True
                else:
                    cache.access(k)
        if scopes:
            yield told()

    return run


def _states(size: int, names: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What the cache of a scope holds where each of its stretches begins, from what all stretches used last."""
    columns = [names["scope"], "_part", "_rank", names["key"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, cache = None, None, Lru(size)
        for batch in batches:
            out = []
            for s, p, r, k, emptied in zip(batch[names["scope"]], batch["_part"], batch["_rank"], _keys(batch[names["key"]]), batch["_emptied"]):
                if part is None or s != at:
                    at, part, cache = s, None, Lru(size)
                if p != part:
                    part = p
                    out += [(s, p, n, x) for n, x in enumerate(cache.put_at)]
                    if emptied:
                        cache = Lru(size)
                if r >= 0:
                    cache.access(k)
            yield pd.DataFrame(out, columns=columns)

    return run


def lru_hits(log: DataFrame, scope: str, key: str, time: str = "ts", tie: str = "event_id", size: int = 2048, clear: str | None = None) -> DataFrame:
    """Accesses with `hit` of a cache per scope. Rows where `clear` is true empty their own scope's cache. Rows without scope or time are left out.

    A scope's log may be spread over any number of tasks; of each stretch at most `size` keys are handed on.
    """
    if scope == key:
        raise ValueError("a cache's scope cannot be its key")
    columns = list(dict.fromkeys([scope, time, tie, key, *([clear] if clear else [])]))
    rows = log.where(F.col(scope).isNotNull() & F.col(time).isNotNull()).select(*columns, F.coalesce(F.col(clear), F.lit(False)).alias("_clear") if clear else F.lit(False).alias("_clear"))
    cut = written(rows.repartitionByRange(scope, time, tie).withColumn("_part", F.spark_partition_id()), "log")
    last = cut.agg(F.max("_part").alias("p")).first().p
    if last is None:
        return log.sparkSession.createDataFrame([], _flagged(cut.select(*columns), "hit"))

    def stretches(df: DataFrame, *order: str) -> DataFrame:
        return df.repartitionById(last + 1, F.col("_part")).sortWithinPartitions(scope, *order)

    names = {"scope": scope, "key": key}
    told = cut.select(scope, "_part", F.lit(0).alias("_rank"), key).schema
    told = StructType([StructField(f.name, f.dataType) for f in told])
    used = stretches(cut, time, tie).mapInPandas(_last_used(size, names), StructType([*told.fields, StructField("_emptied", BooleanType())]))
    states = used.repartition(scope).sortWithinPartitions(scope, "_part", "_rank").mapInPandas(_states(size, names), told)
    both = cut.withColumn("_rank", F.lit(None).cast("int")).unionByName(states, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cache = object(), Lru(size)
        for batch in batches:
            real, hits = batch["_rank"].isna().to_numpy(), np.zeros(len(batch), dtype=bool)
            for n, (s, k, c) in enumerate(zip(batch[scope], _keys(batch[key]), batch["_clear"])):
                if s != at:
                    at, cache = s, Lru(size)
                if real[n] and c:
                    cache = Lru(size)
                else:
                    hits[n] = cache.access(k)
            yield batch[columns][real].assign(hit=hits[real])

    # What a stretch begins with comes before its rows: nulls, of the rows' own rank, sort last.
    ordered = both.repartitionById(last + 1, F.col("_part")).sortWithinPartitions(scope, F.asc_nulls_last("_rank"), time, tie)
    return ordered.select(*columns, "_clear", "_rank").mapInPandas(run, _flagged(cut.select(*columns), "hit"))


def ttl_hits(log: DataFrame, scope: str, key: str, time: str = "ts", tie: str = "event_id", size: int = 256, ttl: float = 300.0, clear: str | None = None) -> DataFrame:
    """Accesses with `hit` of a cache per scope whose entries end after `ttl` seconds; `clear` as for `lru_hits`."""
    return _replay(log, scope, time, tie, lambda: Lru(size, ttl).access, key, "hit", clear)


def cache_stats(hits: DataFrame, scope: str) -> DataFrame:
    """`scope`, `hits`, `misses`, `hit_rate` (4 digits, 0 without accesses)."""
    out = hits.groupBy(scope).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.bround(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 4))
