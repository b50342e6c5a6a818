"""Chat history, context and prompts as columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import split_words, strip

# Fixed value: the instruction that opens every prompt.
SYSTEM = """You are an expert code assistant.

You MUST ONLY answer using the provided code context.
Do NOT explain generally.
Do NOT guess.
Do NOT add outside knowledge.

If the answer is not directly in the code, say:
"I could not find this in the codebase."

When possible, quote or reference the exact code.
Format your answers with markdown: use ```language code blocks, **bold**, bullet points, and headers.
Keep answers concise but thorough."""


def rewrite(history: DataFrame, queries: DataFrame) -> DataFrame:
    """Short follow-ups get their topic back: `query_id`, `rewritten`.

    `history(query_id, pos, role, content)`, `queries(query_id, query)`. The topic is the latest
    user turn of more than three words, else the latest user turn; only queries of fewer than
    three words are completed. Without user turns the stripped query stays.
    """
    user = history.where("role = 'user'")
    words = F.size(split_words(F.coalesce("content", F.lit(""))))
    topic = user.groupBy("query_id").agg(F.max_by("content", F.struct(words > 3, F.col("pos"))).alias("topic"))
    q = strip("query")
    joined = queries.join(topic, "query_id", "left")
    short = (F.size(split_words(q)) < 3) & F.col("topic").isNotNull()
    return joined.select("query_id", F.when(short, F.concat_ws(" ", "topic", q)).otherwise(q).alias("rewritten"))


def block() -> Column:
    """One source in the context: its head and at most 1000 characters of its content."""
    lines = F.when(F.coalesce("start_line", F.lit(0)) != 0, F.concat(F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.lit(")")))
    named = F.when((F.coalesce("name", F.lit("")) != "") & (F.col("name") != F.col("file_name")), F.concat(F.lit(" | "), F.coalesce("type", F.lit("chunk")), F.lit(": "), F.col("name")))
    head = F.concat(F.lit("--- FILE: "), F.coalesce("file_name", F.lit("")), F.coalesce(lines, F.lit("")), F.coalesce(named, F.lit("")), F.lit(" ---\n"))
    return F.concat(head, F.left(F.coalesce("content", F.lit("")), F.lit(1000)))


def context(hits: DataFrame) -> DataFrame:
    """`query_id`, `context`: the hits' blocks by `rank`. A query's hits are few (the search keeps five)."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", block().alias("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x.text), "\n\n---\n\n").alias("context"))


def messages(queries: DataFrame, contexts: DataFrame, history: DataFrame | None = None, turns: int = 6) -> DataFrame:
    """`query_id`, `messages`: the instruction, the last turns, and the question with its context."""
    def turn(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    none = F.array().cast("array<struct<role:string,content:string>>")
    out = queries.join(contexts, "query_id", "left")
    if history is not None:
        recent = history.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("h"))
        out = out.join(recent, "query_id", "left")
        last = F.slice(F.col("h"), F.greatest(F.lit(1), F.size("h") - turns + 1), F.lit(turns))
        past = F.coalesce(F.transform(last, lambda x: turn(x.role, x.content)), none)
    else:
        past = none
    asked = F.concat(F.lit("Use ONLY the provided code context to answer.\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"))
    return out.select("query_id", F.concat(F.array(turn(F.lit("system"), F.lit(SYSTEM))), past, F.array(turn(F.lit("user"), asked))).alias("messages"))


def sources(hits: DataFrame) -> DataFrame:
    """What a hit shows: `query_id`, `rank`, `file`, `lines`, `name`, `via` (null but for graph chunks)."""
    q = F.lit("?")
    lines = F.concat(F.coalesce(F.col("start_line").cast("string"), q), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), q))
    via = F.when(F.col("is_graph"), F.lit("dependency graph")) if "is_graph" in hits.columns else F.lit(None).cast("string")
    return hits.select("query_id", "rank", F.col("file_name").alias("file"), lines.alias("lines"), F.coalesce("name", "file_name").alias("name"), via.alias("via"))


def frame(payload: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
