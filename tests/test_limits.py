import datetime as dt
import random
from collections import OrderedDict

from pyspark.sql import functions as F

from quarry.operators import limits
from quarry.streaming import limits as stream_limits
from quarry.streaming import progress

START = dt.datetime(2024, 1, 1)


def _log(spark, rows):
    return spark.createDataFrame([(n, k, s, None if t is None else START + dt.timedelta(seconds=t)) for n, (s, k, t) in enumerate(rows)], "event_id long, key string, scope string, ts timestamp")


def test_limiter_cases(spark):
    rows = [("a", "k", 0), ("a", "k", 1), ("a", "k", 2), ("b", "k", 2), ("a", "k", 61), (None, "k", 3), ("a", "k", None)]
    got = {r.event_id: r.allowed for r in limits.rate_limited(_log(spark, rows), "scope", limit=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_limiter_agrees_with_a_plain_one(spark):
    rng = random.Random(1)
    rows = sorted((("abc"[rng.randrange(3)], "k", rng.randrange(400)) for _ in range(300)), key=lambda r: r[2])
    held, expected = {}, {}
    for n, (s, _, t) in enumerate(rows):
        times = [x for x in held.get(s, []) if x > t - 60]
        expected[n] = len(times) < 5
        held[s] = times + [t] if expected[n] else times
    assert {r.event_id: r.allowed for r in limits.rate_limited(_log(spark, rows), "scope", limit=5).collect()} == expected


def test_lru_agrees_with_a_plain_one(spark):
    rng = random.Random(2)
    rows = [("s", str(rng.randrange(12)), n) for n in range(400)]
    cache, expected = OrderedDict(), {}
    for n, (_, k, _) in enumerate(rows):
        expected[n] = k in cache
        cache[k] = 1
        cache.move_to_end(k)
        if len(cache) > 5:
            cache.popitem(last=False)
    hits = limits.lru_hits(_log(spark, rows), "scope", "key", size=5)
    assert {r.event_id: r.hit for r in hits.collect()} == expected
    stats = limits.cache_stats(hits, "scope").collect()[0]
    assert stats.hits + stats.misses == 400 and stats.hit_rate == round(stats.hits / 400, 4)
    assert limits.cache_stats(hits.limit(0), "scope").count() == 0


def test_a_hot_cache_is_replayed_in_stretches(spark):
    # One scope holds nearly all rows, some of which empty it; other scopes lie between. Keys are null at times.
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("xyz"), rng.choice([None, *"abcdefghijklmnop"]), n // 2, rng.random() < 0.004) for n in range(6000)]
    df = spark.createDataFrame([(n, s, k, START + dt.timedelta(seconds=t), c) for n, (s, k, t, c) in enumerate(rows)], "event_id long, scope string, key string, ts timestamp, fresh boolean")
    caches, expected = {}, {}
    for n, (s, k, _, c) in enumerate(rows):
        held = caches.setdefault(s, OrderedDict())
        if c:
            held.clear()
            expected[n] = False
            continue
        expected[n] = k in held
        held[k] = 1
        held.move_to_end(k)
        if len(held) > 9:
            held.popitem(last=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = limits.lru_hits(df, "scope", "key", size=9, clear="fresh")
        assert {r.event_id: r.hit for r in got.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.rdd.getNumPartitions() == 4  # the hot scope is no one task's work
    assert limits.lru_hits(df.limit(0), "scope", "key").count() == 0


def test_ttl(spark):
    rows = [("s", "a", 0), ("s", "a", 299), ("s", "a", 300), ("s", "a", 599), ("t", "a", 1), ("s", "b", 600), ("s", "c", 601), ("s", "a", 602)]
    got = {r.event_id: r.hit for r in limits.ttl_hits(_log(spark, rows), "scope", "key", size=2).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    zero = limits.ttl_hits(_log(spark, rows[:2]), "scope", "key", ttl=0.0).collect()
    assert not any(r.hit for r in zero)


def test_streaming_limiter(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, event_id long, t double"
    spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 3, 1.0)], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", 4, 2.0), ("a", 5, 61.5)], schema).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream_limits.rate_limited(events, limit=2, expire=False).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    ended = run.awaitTermination(120)
    run.stop()
    assert ended
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got[1] and got[2] and got[3] and got[5] and not got[4]


def test_streaming_limiter_orders_a_micro_batch(spark, tmp_path):
    # A key's rows fill several Arrow batches in no order.
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, event_id long, t double"
    order = list(range(300))
    random.Random(3).shuffle(order)
    spark.createDataFrame([("a", n, float(n)) for n in order], schema).coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        run = stream_limits.rate_limited(spark.readStream.schema(schema).parquet(source), limit=3, window=100.0, expire=False)
        run = run.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.event_id for r in spark.read.parquet(out).where("allowed").collect()) == [0, 1, 2, 100, 101, 102, 200, 201, 202]


def test_limits_of_nothing():
    assert not limits.SlidingWindow(0).allow(1.0)
    cache = limits.Lru(0)
    assert not cache.access("a") and not cache.access("a")


def test_progress(spark, tmp_path):
    path = str(tmp_path / "progress")
    for n, stage in enumerate(("loading", "chunking", "done")):
        progress.append(spark, path, "j", n, stage)
    assert [(r.stage, r.pct) for r in progress.read(spark, path, "j", 1).collect()] == [("chunking", 30), ("done", 100)]
    assert progress.stream(spark, path).isStreaming and F is not None
