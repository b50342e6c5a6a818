"""The evaluation run: questions searched, timed, judged and reported."""

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluation
from quarry.plans.retrieve import DEFAULTS, Index, search
from quarry.plans.scratch import written
from quarry.settings import Settings
from quarry.sources.store import pretty

#: Results of a question that are judged.
DEPTH = 10


def evaluate(index: Index, questions: DataFrame, keywords: bool = True, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(details of each question, report). `questions(query_id, query, embedding, expected_files, expected_names)`.

    All questions are one job, so a question's latency is its share of that job's time.
    """
    start = time.perf_counter()
    hits = written(search(index, questions, keywords, settings, DEPTH), "hits")
    took = (time.perf_counter() - start) * 1000
    chunks = index.chunks.select("chunk_id", "file_name", "name", "content")
    details = evaluation.per_query(hits.join(chunks, "chunk_id"), questions).join(questions.select("query_id", "query"), "query_id")
    details = details.withColumn("latency_ms", F.bround(F.lit(took) / F.lit(max(1, questions.count())), 2))
    mean = F.bround(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("mean_latency_ms")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    return details, evaluation.report(details, mean).select(stamp, "*")


def document(runs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """All runs as one JSON document (`json`): per run its report and, under `query_details`, its questions. An evaluation set is small."""

    def of(name: str) -> DataFrame:
        details, report = runs[name]
        questions = details.agg(F.array_sort(F.collect_list(F.struct(*details.columns))).alias("query_details"))
        return report.crossJoin(questions).select(F.struct("*").alias(name))  # one row with one row

    out: DataFrame | None = None
    for name in runs:
        out = of(name) if out is None else out.crossJoin(of(name))
    columns: list[Column | str] = list(runs)
    return out.select(pretty(F.struct(*columns)).alias("json"))
