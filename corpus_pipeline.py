"""From raw documents to packed training sequences: the stages and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, jaccard_join, mixing, packing, quality
from docloom.llm.common import stash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on `labels`, scores 0.5 or higher."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded), the row with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the one with the least doc_id."""
    return jaccard_join.keep_one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents repeat, or are cut to the words that the mix takes."""
    return mixing.mix(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids; doc_row tells the rows of a repeated document apart."""
    return packing.packed_digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", no_exact_copies),
    ("n-gram Jaccard join", no_near_copies),
    ("mixing sources", mixed_sources),
    ("packing", packed_windows),
]

#: A classifier is fitted and texts are tokenized, which SQL cannot express; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over `documents`; each is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
