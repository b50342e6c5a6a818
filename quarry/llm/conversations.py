"""Problem 6: message rows put back together as ordered conversations.

Kahn's algorithm orders the reply graph of each session, ties going to the earlier time and then the
smaller id: a row's parent is the one named by `reply_to` where the table has such a column, else
the row before it. Rows that Kahn's algorithm leaves over lie on or behind a cycle. A session of up
to `SESSION_ROWS` rows is ordered in one task; a larger one by pointer jumping over the whole table,
which gives the same order. Rows are then range-partitioned by that order, so that a session of any
size is spread over as many partitions as it needs, and the stretches are joined at the partition
borders, of which there are no more than partitions.
"""

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.scratch import written

#: Rows of a session up to which one task holds its reply graph; larger ones take the distributed way.
SESSION_ROWS = 100_000

_SPACE = r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$"


def norm_role(column: str = "role") -> Column:
    """The role without case and outer blanks; null becomes the empty string."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), _SPACE, ""))


def says_something(column: str = "content") -> Column:
    """Whether a text has a letter or a digit of any script."""
    return F.coalesce(F.col(column), F.lit("")).rlike(r"[\p{L}\p{Nd}]")


def prepared(messages: DataFrame, texts: bool = True) -> DataFrame:
    """One row per `id` (the last loaded; rows without an id are left out) with a session, `role` normalised; system rows included.

    Without `texts` the content shrinks, before the shuffle, to whether it says something.
    """
    columns = [c for c in ("session_id", "role", "created_at", "reply_to") if c in messages.columns]
    content = F.col("content") if texts else F.when(says_something(), F.lit("x")).otherwise(F.lit(""))
    # The whole row ranks, so that two deliveries with equal load times still give one answer, with texts or without.
    row = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", *columns, F.xxhash64("content"), content.alias("content"))
    last = messages.where("id is not null").groupBy("id").agg(F.max(row).alias("r"))
    out = last.select("id", *[F.col(f"r.{c}").alias(c) for c in (*columns, "content")])
    return out.where("session_id is not null").withColumn("role", norm_role())


def _kahn(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """Rows (time, id, parent) of one reply graph: their places in topological order, and those on or behind a cycle."""
    at = {r[1]: k for k, r in enumerate(rows)}
    children: list[list[int]] = [[] for _ in rows]
    waits = [0] * len(rows)
    for k, r in enumerate(rows):
        parent = at.get(r[2])
        if parent is not None:
            children[parent].append(k)
            waits[k] += 1
    ready = [(rows[k][0], rows[k][1], k) for k, w in enumerate(waits) if not w]
    heapq.heapify(ready)
    out = []
    while ready:
        _, _, k = heapq.heappop(ready)
        out.append(k)
        for c in children[k]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(ready, (rows[c][0], rows[c][1], c))
    placed = set(out)
    return out, [k for k in range(len(rows)) if k not in placed]


_PLACED = "session_id string, id long, place array<struct<t:timestamp,id:long>>, leftover boolean"


def _placed_by_session(rows: DataFrame) -> DataFrame:
    """Places in Kahn's order, each session in one task: `session_id`, `id`, `place`, `leftover`."""

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def flush() -> list[tuple]:
            out, left = _kahn(held)
            return [(at, held[k][1], [(None, n)], n >= len(out)) for n, k in enumerate(out + left)]

        columns = ["session_id", "id", "place", "leftover"]
        for batch in batches:
            done = []
            for session, row, time, parent in zip(batch.session_id, batch.id, batch.created_at, batch.reply_to):
                if session != at:
                    done += flush() if held else []
                    at, held = session, []
                held.append((time, row, None if parent is None else int(parent)))
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(flush() if held else [], columns=columns)

    sorted_rows = rows.select("session_id", "id", "created_at", F.col("reply_to").cast("string").alias("reply_to")).repartition("session_id").sortWithinPartitions("session_id", "created_at", "id")
    return sorted_rows.mapInPandas(order, _PLACED)


def _placed_by_jumps(rows: DataFrame, most: int) -> DataFrame:
    """The same for sessions of up to `most` rows, spread over all tasks.

    A row waits for the rows above it, so in Kahn's order it comes behind the latest of them, among
    what waited for the same row behind the latest below that, and so on: by the later ones on its
    path, from the top. Each round doubles the stretch of path a row knows; after as many rounds as
    double past the session's size, a row that still has a row above it never ends: a cycle.
    """
    own = rows.select("session_id", "id", "reply_to", F.array(F.struct(F.col("created_at").alias("t"), F.col("id").alias("id"))).alias("place"))
    above = rows.select("session_id", F.col("id").alias("reply_to"), F.col("id").alias("up"))  # a parent that is not there counts as none
    nodes = own.join(above, ["session_id", "reply_to"], "left").select("session_id", "id", "up", "place")
    nodes, steps = written(nodes, "jumps"), 1
    while steps <= 2 * most and not nodes.where("up is not null").isEmpty():
        higher = nodes.select("session_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"))
        later = F.when(F.col("place2").isNull(), F.col("place")).otherwise(F.concat(F.filter("place2", lambda x: x > F.col("place")[0]), "place"))
        nodes, steps = written(nodes.join(higher, ["session_id", "up"], "left").select("session_id", "id", F.col("up2").alias("up"), later.alias("place")), "jumps"), 2 * steps
    left = F.col("up").isNotNull()
    return nodes.select("session_id", "id", F.when(left, F.slice("place", -1, 1)).otherwise(F.col("place")).alias("place"), left.alias("leftover"))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with `place` (its order within the session) and `leftover` (on or behind a cycle, then last)."""
    if "reply_to" not in rows.columns:
        # Each row answers the one before, by time and id: the chain's only topological order.
        return rows.withColumn("place", F.array(F.struct(F.col("created_at").alias("t"), F.col("id").alias("id")))).withColumn("leftover", F.lit(False))
    sizes = written(rows.groupBy("session_id").agg(F.count("*").alias("size")), "sizes")
    large = sizes.where(F.col("size") > SESSION_ROWS)
    most = large.agg(F.max("size").alias("m")).first().m
    found = _placed_by_session(rows.join(large, "session_id", "left_anti"))
    if most is not None:
        found = found.unionByName(_placed_by_jumps(rows.join(large, "session_id", "left_semi"), most))
    return rows.join(found, ["session_id", "id"])


_TURNS = "session_id string, pid int, pos long, id long, role string, content string, created_at timestamp, leftover boolean, prev_id long, prev_role string, prev_content string"


def ordered_turns(messages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Turns of the sessions in which every row has a time, without system rows, each with the turn before it.

    Columns: `session_id`, `pid`, `pos` (order: pid, pos), `id`, `role`, `content`, `created_at`,
    `leftover` (on a cycle of replies), `prev_id`, `prev_role`, `prev_content`.
    """
    rows = prepared(messages) if rows is None else rows
    undated = rows.where("created_at is null").select("session_id").distinct()
    rows = rows.join(undated, "session_id", "left_anti").where("role <> 'system'")
    rows = placed(rows.select("session_id", "id", "role", "content", "created_at", *(["reply_to"] if "reply_to" in rows.columns else [])))
    by = ["session_id", "leftover", "place"]
    ranged = rows.drop("reply_to").repartitionByRange(*by).sortWithinPartitions(*by)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pos, before, columns = None, 0, (None, None, None), [c.split()[0] for c in _TURNS.split(", ")]
        for batch in batches:
            done = []
            for session, pid, row, role, content, time, over in zip(batch.session_id, batch.pid, batch.id, batch.role, batch.content, batch.created_at, batch.leftover):
                if session != at:
                    at, pos, before = session, 0, (None, None, None)
                done.append((session, pid, pos, row, role, content, time, over, *before))
                pos, before = pos + 1, (row, role, content)
            yield pd.DataFrame(done, columns=columns)

    turns = written(ranged.withColumn("pid", F.spark_partition_id()).mapInPandas(order, _TURNS), "turns")
    ends = turns.groupBy("session_id", "pid").agg(F.max_by(F.struct("id", "role", "content"), "pos").alias("last"))
    crossing = ends.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").select("session_id")
    # Sessions that lie across a border: no more than there are borders, and no more stretches than partitions.
    ends = ends.join(crossing, "session_id", "left_semi")
    before = ends.select("session_id", "pid", F.lag("last").over(Window.partitionBy("session_id").orderBy("pid")).alias("before")).where("before is not null")
    joined = turns.join(before.withColumn("pos", F.lit(0).cast("long")), ["session_id", "pid", "pos"], "left")
    return joined.select(
        *[c.split()[0] for c in _TURNS.split(", ") if not c.startswith("prev_")],
        *[F.coalesce(f"before.{c}", f"prev_{c}").alias(f"prev_{c}") for c in ("id", "role", "content")],
    )


def _flags(sessions: DataFrame, messages: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Per session id what speaks against it, and the ordered turns (without `texts` they tell only whether they say something)."""
    all_rows = written(prepared(messages, texts), "prepared")
    turns = ordered_turns(messages, all_rows)
    has_text = says_something()
    # A turn tells about itself and about the turn before it; the last turn of a session is told by the maximum.
    told = turns.withColumn("text", has_text).select(
        "session_id",
        (F.col("leftover") | (F.col("role") == "assistant") & (F.coalesce("prev_role", F.lit("assistant")) == "assistant")).alias("disorder"),
        ((F.col("prev_role") == "user") & ~((F.col("role") == "assistant") & F.col("text"))).alias("unanswered"),
        F.struct("pid", "pos", "role").alias("at"),
    )
    order = told.groupBy("session_id").agg(F.max("disorder").alias("disorder"), F.max("unanswered").alias("unanswered"), (F.max("at")["role"] == "user").alias("open"))
    spoken = F.col("role") != "system"
    rows = all_rows.groupBy("session_id").agg(
        F.max(spoken & says_something()).alias("text"),
        F.max(F.col("created_at").isNull()).alias("undated"),
        F.max(spoken & ~F.col("role").isin("user", "assistant")).alias("stranger"),
    )
    known = sessions.where("id is not null").select(F.col("id").alias("session_id"), F.lit(True).alias("known")).distinct()
    mentioned = messages.where("session_id is not null").select("session_id").distinct()
    ids = known.select("session_id").union(mentioned).distinct()
    out = ids.join(known, "session_id", "left").join(rows, "session_id", "left").join(order, "session_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(~flag("text"), "empty")
        .when(~flag("known") | flag("undated") | flag("stranger") | flag("disorder"), "broken")
        .when(flag("unanswered") | flag("open"), "missing_reply")
    )
    return out.select("session_id", reason.alias("reason")), turns


def dropped(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions to drop: `session_id`, `reason` ('empty', 'broken' or 'missing_reply', the first that holds).

    Ids come from both tables; a session without rows is empty. Null ids are no sessions. Empty tables give no row.
    """
    return _flags(sessions, messages, texts=False)[0].where("reason is not null")


def conversations(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Whole conversations as turns: `session_id`, `turn` (from 1), `id`, `role`, `created_at`, `content`.

    One row per turn, not one array per session: a session of millions of turns stays spread out.
    """
    reasons, turns = _flags(sessions, messages, texts=True)
    kept = turns.join(reasons.where("reason is null"), "session_id", "left_semi")
    sizes = kept.groupBy("session_id", "pid").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("session_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("session_id", "pid", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    numbered = kept.join(offsets, ["session_id", "pid"])
    return numbered.select("session_id", (F.col("offset") + F.col("pos") + 1).alias("turn"), "id", "role", "created_at", "content")
