"""Retrieval quality: precision at k, reciprocal rank, reports and comparisons."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in evaluation set (query, expected files, expected names).
BUILT_IN = [
    ("How does the login function work?", ["auth.py"], ["login"]),
    ("Show me the UserService class", ["users.py"], ["UserService"]),
    ("How is data processed?", ["utils.py"], ["process_data"]),
    ("What are the API endpoints?", ["main.py", "routes.py"], []),
    ("How does authentication work?", ["auth.py"], ["login"]),
    ("database query methods", ["users.py"], ["UserService", "get_user"]),
    ("delete user", ["users.py"], ["delete_user"]),
    ("error handling patterns", [], []),
]
DEPTHS = (1, 3, 5)


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(n, *r) for n, r in enumerate(BUILT_IN)]
    return spark.createDataFrame(rows, "query_id long, query string, expected_files array<string>, expected_names array<string>")


def relevant() -> Column:
    """An expected file in the file name, or an expected name in name or content whatever its case. No expectation, not relevant."""
    text = lambda c: F.coalesce(c, F.lit(""))
    by_file = F.exists("expected_files", lambda e: F.contains(text("file_name"), e))
    by_name = F.exists("expected_names", lambda e: F.contains(F.lower(text("name")), F.lower(e)) | F.contains(F.lower(text("content")), F.lower(e)))
    return F.coalesce(by_file, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def per_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id`, `p_at_1`, `p_at_3`, `p_at_5`, `reciprocal_rank`, `results`, `retrieved_files`, `retrieved_names`: over all queries, hits or none.

    The last two are of the first five hits, in order, empty texts for nulls.

    `hits(query_id, rank from 0, file_name, name, content)`. The divisor of p@k is k, however few the hits.
    """
    judged = hits.join(queries.select("query_id", "expected_files", "expected_names"), "query_id").select("query_id", "rank", relevant().alias("good"), "file_name", "name")
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") < max(DEPTHS), F.struct("rank", "file_name", "name"))))
    counted = judged.groupBy("query_id").agg(
        *[(F.count_if(F.col("good") & (F.col("rank") < k)) / F.lit(k)).alias(f"p_at_{k}") for k in DEPTHS],
        (1 / (F.min(F.when(F.col("good"), F.col("rank"))) + 1)).alias("reciprocal_rank"),
        F.count("*").alias("results"),
        F.transform(shown, lambda x: F.coalesce(x.file_name, F.lit(""))).alias("retrieved_files"),
        F.transform(shown, lambda x: F.coalesce(x["name"], F.lit(""))).alias("retrieved_names"),
    )
    out = queries.select("query_id").join(counted, "query_id", "left")
    out = out.na.fill(0.0, [*(f"p_at_{k}" for k in DEPTHS), "reciprocal_rank"]).na.fill(0, ["results"])
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("retrieved_files", "retrieved_names")})


def report(scores: DataFrame, *more: Column) -> DataFrame:
    """Means over all queries, to 4 digits (half to even): `queries`, `p_at_1`, `p_at_3`, `p_at_5`, `mrr`, and what `more` adds. No queries: zeros."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return scores.agg(F.count("*").alias("queries"), *[mean(f"p_at_{k}").alias(f"p_at_{k}") for k in DEPTHS], mean("reciprocal_rank").alias("mrr"), *more)


def compare(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports one below the other under `run`, with `mrr_delta` to the first of them."""
    names = list(reports)
    out = None
    for n, name in enumerate(names):
        part = reports[name].withColumns({"run": F.lit(name), "run_ord": F.lit(n)})
        out = part if out is None else out.unionByName(part)
    base = reports[names[0]].select(F.col("mrr").alias("base"), F.lit(1).alias("one"))
    return out.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").select("run", "queries", "p_at_1", "p_at_3", "p_at_5", "mrr", F.bround(F.col("mrr") - F.col("base"), 4).alias("mrr_delta"))
