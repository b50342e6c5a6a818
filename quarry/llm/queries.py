"""The registered pN_ queries: each applies an operator to its whole tables with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import conversations, leakage, packing, pairs, provenance, reading, secrets, splitting, syntax, vectors
from quarry.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, folder, "chunk_vectors"), 0.9).select("chunk_id_a", "chunk_id_b")


@query
def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_chunks(table(spark, folder, "chunk_vectors"))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.parse_defects(_documents(spark, folder)).where("defect is not null").select("doc_id").distinct()


@query
def p2_defects(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.parse_defects(_documents(spark, folder)).where("defect is not null")


@query
def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.defect_rates(_documents(spark, folder))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.scanned(_documents(spark, folder), spread(table(spark, folder, "chunks")))
    return rows.select("origin", "row_id", F.explode("line_nos").alias("line_no")).distinct()


@query
def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(_documents(spark, folder), spread(table(spark, folder, "chunks"))).select("origin", "row_id", "masked")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pair_defects(table(spark, folder, "messages")).select("prompt_id", "response_id", "defect")


@query
def p4_all_defects(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pair_defects(table(spark, folder, "messages")).select("prompt_id", "response_id", F.explode("defects").alias("defect"))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.dropped(table(spark, folder, "sessions"), table(spark, folder, "messages"))


@query
def p6_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "sessions"), table(spark, folder, "messages"))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.not_handwritten(_documents(spark, folder)).where("valid").select("doc_id", "kind")


@query
def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.not_handwritten(_documents(spark, folder)).groupBy("project_id", "kind").agg(F.count("*").alias("files"))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.cut_kinds(table(spark, folder, "chunks"))


@query
def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_chunks(table(spark, folder, "chunks"))


@query
def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The text that a chunk's pieces give without their overlaps, and whether all keep to the bounds."""
    pieces = splitting.split_chunks(table(spark, folder, "chunks"))
    own = F.struct("piece", F.substring("content", F.col("overlap") + 1, F.length("content")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x.text), "")
    bounds = (F.max(F.length("content")) <= splitting.LIMIT) & (F.max("overlap") <= splitting.OVERLAP)
    return pieces.where("content is not null").groupBy("chunk_id").agg(F.md5(joined).alias("content"), bounds.alias("bounded"))


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the packing had to cut into more than one part."""
    parts = packing.packed(table(spark, folder, "documents")).where("part = 1")
    return parts.select("doc_id").distinct()


@query
def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing did with each document: its parts, their tokens, and whether all their containers hold what is in them."""
    placed = packing.packed(table(spark, folder, "documents"))
    filled = placed.groupBy("container_id").agg((F.sum("tokens") <= packing.CAPACITY).alias("holds"))
    return placed.join(filled, "container_id").groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"), F.min("holds").alias("holds"))


@query
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@query
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    fill = packing.packed(table(spark, folder, "documents")).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return fill.agg(F.count("*").alias("containers"), F.avg(F.col("tokens") / packing.CAPACITY).alias("fill"), F.sum((F.col("tokens") == packing.CAPACITY).cast("long")).alias("full"))


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(_documents(spark, folder), table(spark, folder, "eval_items"))
    return found.where("kind = 'verbatim'").select("item_id", "doc_id").distinct()


@query
def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_documents(spark, folder), table(spark, folder, "eval_items"))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    graded = reading.levels(_documents(spark, folder), table(spark, folder, "reading_labels"))
    return graded.where("level in ('basic', 'advanced')").select("doc_id", "level").distinct()


@query
def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.levels(_documents(spark, folder), table(spark, folder, "reading_labels"), prose_only=False)


@query
def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    graded = reading.levels(_documents(spark, folder), table(spark, folder, "reading_labels"), prose_only=False)
    return graded.groupBy(F.round("grade").cast("int").alias("grade")).agg(F.count("*").alias("documents"))
