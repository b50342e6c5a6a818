"""BM25 over chunks: fitted tables, scores and ranked lists.

The inverted index is a table of postings; a query touches only its own terms' postings. Many
queries run in one plan keyed by `query_id`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens

K1, B = 1.5, 0.75
#: Query terms up to which they are broadcast to the postings; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Folders over which a stored index deals its terms: a question reads those of its own terms.
BUCKETS = 64


@dataclass(frozen=True)
class Bm25:
    """`postings(chunk_id, term, tf, dl)`, `lengths(chunk_id, dl)`, `frequencies(term, df)`, `corpus(n, avg_dl)` (one row)."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    corpus: DataFrame


def terms(chunks: DataFrame, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """Term frequencies: `key`, `term`, `tf`. Null and empty texts give no row."""
    return chunks.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit(chunks: DataFrame, text: str = "content", only: DataFrame | None = None) -> Bm25:
    """The tables of a corpus. Texts without a token count in `n` and in the mean length (which is 1 for no texts).

    With `only(term)` postings and frequencies are kept for these terms alone, before anything is
    shuffled: enough, and exact, for queries that ask for no others.
    """
    split = chunks.select("chunk_id", tokens(text).alias("ts"))
    found = split.select("chunk_id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    if only is not None:
        found = found.join(only.select("term").distinct(), "term", "left_semi")
    postings = found.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    lengths = split.select("chunk_id", F.size("ts").cast("long").alias("dl"))
    return Bm25(postings, lengths, *summed(postings, lengths))


def bucket() -> Column:
    """The folder of a term in a stored index."""
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def bucketed(rows: DataFrame, *within: str) -> DataFrame:
    """Rows by term as they are stored: in folders by bucket, sorted by term and `within`. Ranges cut a frequent term into several tasks and a folder into few files."""
    by = ["bucket", "term", *within]
    return rows.select("*", bucket()).repartitionByRange(*by).sortWithinPartitions(*by)


def summed(postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies and the corpus row of postings and lengths."""
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    return frequencies, lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """`query_id`, `term`, `qtf`: a repeated query word counts each time."""
    return queries.select("query_id", F.explode(tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Bm25, queries: DataFrame, text: str = "query") -> DataFrame:
    """`query_id`, `chunk_id`, `score` of the chunks that share a term with the query; all others score 0.

    The postings are joined on the term, so rare terms cost little; sums are combined per map
    task before the shuffle. Counted to be few, the query terms go to the postings, so a term that
    every text has stays spread over all tasks; the one corpus row rides along.
    """
    asked = query_terms(queries, text)
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # In a stored index the terms' buckets prune what is read (dynamic partition pruning).
    on = ["bucket", "term"] if "bucket" in index.postings.columns else ["term"]
    asked = (asked.select("*", bucket()) if len(on) > 1 else asked).join(index.frequencies, on)
    corpus = F.broadcast(index.corpus.withColumn("one", F.lit(1)))
    weighted = asked.withColumn("one", F.lit(1)).join(corpus, "one").select(
        "query_id", *on, "avg_dl", (F.col("qtf") * F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("weight")
    )
    tf, norm = F.col("tf"), 1 - B + B * F.col("dl") / F.when(F.col("avg_dl") == 0, 1.0).otherwise(F.col("avg_dl"))
    hits = index.postings.join(F.broadcast(weighted) if few else weighted, on)
    part = F.col("weight") * (tf * (K1 + 1)) / (tf + K1 * norm)
    # To 9 digits, so that the order of summation decides no tie between equal texts.
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))


def ranked(index: Bm25, queries: DataFrame, k: int = 20, text: str = "query", found: DataFrame | None = None) -> DataFrame:
    """The best k chunks of each query: `query_id`, `chunk_id`, `score`, `rank` (from 0), ties to the smaller id.

    Chunks that score 0 stay in the list, so where fewer than k match, those with the smallest
    ids fill it up; then all that match are among the best, so 2k smallest ids always suffice.
    They travel as one array. `found` may hold the queries' scores already.
    """
    found = scores(index, queries, text) if found is None else found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    first = [r.chunk_id for r in index.lengths.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * k).collect()]
    padding = queries.select("query_id", F.explode(F.lit(first).cast("array<bigint>")).alias("chunk_id"), F.lit(0.0).alias("score"))
    pool = best.unionByName(padding).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return pool.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
