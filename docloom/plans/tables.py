"""The given tables, and the knowledge-base tables that are made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, estimate_tokens

CATEGORIES = ("statutory_code", "regulation", "case_law", "faq", "agency_guidance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as chunks."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return lines.select(
        (F.col("doc_id") * 100_000 + F.col("i")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("i").alias("chunk_index"),
        F.substring("source", 4, 9).cast("int").alias("source_id"), F.col("lang").alias("language"), "content",
        estimate_tokens(F.col("content")).alias("token_count"), content_hash(F.col("content")).alias("content_hash"),
        ((F.col("doc_id") + F.col("i")) % 7 != 0).alias("is_active"), category.alias("content_category"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id * 100000 + i AS chunk_id, doc_id AS document_id, i AS chunk_index, CAST(substr(source, 4, 9) AS INT) AS source_id,
         lang AS language, ls[i + 1] AS content, greatest(1, length(ls[i + 1]) // 4) AS token_count, sha256(ls[i + 1]) AS content_hash,
         (doc_id + i) % 7 <> 0 AS is_active,
         CASE doc_id % 5 WHEN 0 THEN 'statutory_code' WHEN 1 THEN 'regulation' WHEN 2 THEN 'case_law' WHEN 3 THEN 'faq' ELSE 'agency_guidance' END AS content_category
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS t(i)
)"""
