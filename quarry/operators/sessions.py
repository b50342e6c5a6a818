"""Projects, sessions and messages: event-sourced tables, latest state wins, deletes are tombstones."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from quarry.functions.text import strip

PROJECTS = StructType([
    StructField("id", StringType(), False), StructField("name", StringType(), False), StructField("path", StringType(), False), StructField("language", StringType()),
    StructField("files_count", LongType()), StructField("chunks_count", LongType()), StructField("created_at", TimestampType(), False), StructField("updated_at", TimestampType(), False),
])
SESSIONS = StructType([
    StructField("id", StringType(), False), StructField("title", StringType(), False), StructField("project_id", StringType()), StructField("owner_id", StringType()),
    StructField("created_at", TimestampType(), False), StructField("updated_at", TimestampType(), False),
])
MESSAGES = StructType([
    StructField("id", LongType(), False), StructField("session_id", StringType(), False), StructField("role", StringType(), False), StructField("content", StringType(), False), StructField("created_at", TimestampType(), False),
])


def latest(rows: DataFrame, key: str = "id", by: str = "updated_at") -> DataFrame:
    """The newest state of each key. Equal times go to the greater row; a null time is older than any. Null keys are left out."""
    rest = [c for c in rows.columns if c not in (key, by)]
    newest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(by, *rest)).alias("r"))
    return newest.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def once(messages: DataFrame) -> DataFrame:
    """Messages without redeliveries: the last loaded row of each id."""
    return latest(messages, "id", "loaded_at")


def migrate(sessions: DataFrame) -> DataFrame:
    """Sessions of an older table get the owner column."""
    return sessions if "owner_id" in sessions.columns else sessions.withColumn("owner_id", F.lit(None).cast("string"))


def listed(rows: DataFrame, owner: str | None = None, public: bool = False) -> DataFrame:
    """Rows newest first; in public mode only the owner's own (an owner that is null owns nothing)."""
    if public:
        rows = rows.where(F.col("owner_id").isNotNull() & (F.col("owner_id") == F.lit(owner)))
    return rows.orderBy(F.desc_nulls_last("updated_at"), "id")


def owned(owner: str | Column | None, public: bool) -> Column:
    """Whether a session may be seen: private mode sees all, public mode the owner's own; a null owner owns nothing."""
    return F.coalesce(F.col("owner_id") == F.lit(owner), F.lit(False)) if public else F.lit(True)


def role_of(column: str = "role") -> Column:
    return F.lower(strip(F.coalesce(F.col(column), F.lit(""))))


def last_turns(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n user and assistant turns of each session, oldest first: `session_id`, `pos` (from 0), `id`, `role`, `content`.

    Rows of other roles, without a session or without a time are left out; equal times go by id.
    """
    rows = messages.select("session_id", "id", role_of().alias("role"), "content", "created_at")
    rows = rows.where("session_id is not null and created_at is not null and role in ('user', 'assistant')")
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    oldest = Window.partitionBy("session_id").orderBy("created_at", "id")
    return kept.select("session_id", (F.row_number().over(oldest) - 1).alias("pos"), "id", "role", "content")


def first_questions(messages: DataFrame) -> DataFrame:
    """The first user turn of each session: `session_id`, `content`. Rows count and are ordered as in `last_turns`."""
    asked = messages.where("session_id is not null and created_at is not null").where(role_of() == "user")
    return asked.groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("content"))


def update_stats(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """New `files_count` and `chunks_count` by `id`, with their `updated_at`; other projects stay."""
    new = stats.select("id", F.col("files_count").alias("_f"), F.col("chunks_count").alias("_c"), F.col("updated_at").alias("_u"), F.lit(True).alias("_new"))
    joined = projects.join(new, "id", "left")
    pick = lambda c, n: F.when(F.col("_new"), F.col(n)).otherwise(F.col(c)).alias(c)
    changed = {"files_count": "_f", "chunks_count": "_c", "updated_at": "_u"}
    return joined.select(*[pick(c, changed[c]) if c in changed else F.col(c) for c in projects.columns])


def touch(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with `updated_at` moved to their latest message, where that is later."""
    last = messages.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("_m"))
    joined = sessions.join(last, "id", "left")
    return joined.select(*[F.greatest("updated_at", "_m").alias("updated_at") if c == "updated_at" else F.col(c) for c in sessions.columns])


def retitle(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions under their new titles (`titles(id, title)`, ids unique)."""
    joined = sessions.join(titles.select("id", F.col("title").alias("_t")), "id", "left")
    return joined.select(*[F.coalesce("_t", "title").alias("title") if c == "title" else F.col(c) for c in sessions.columns])


def delete_sessions(sessions: DataFrame, messages: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of `deleted(id)`."""
    gone = deleted.select("id").distinct()
    left = messages.join(gone.withColumnRenamed("id", "session_id"), "session_id", "left_anti").select(*messages.columns)
    return sessions.join(gone, "id", "left_anti").select(*sessions.columns), left


def delete_projects(projects: DataFrame, sessions: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects without those of `deleted(id)`; their sessions stay without a project."""
    gone = deleted.select("id").distinct()
    freed = sessions.join(gone.select(F.col("id").alias("project_id"), F.lit(True).alias("_gone")), "project_id", "left")
    freed = freed.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "project_id" else F.col(c) for c in sessions.columns])
    return projects.join(gone, "id", "left_anti").select(*projects.columns), freed
