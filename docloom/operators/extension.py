"""Where users hook in: a table function for SQL, and scorers that reranking calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.operators.retrieval import reranked

#: How a text may be cut, and the columns that each way adds.
WAYS = {"line": [], "paragraph": [StructField("n_lines", IntegerType())], "words": [StructField("n_words", IntegerType())]}


class _Pieces:
    """Pieces of a text in order; the columns follow from how it is cut."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        pass

    @staticmethod
    def analyze(text: AnalyzeArgument, way: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not way.isConstantExpression or way.value not in WAYS:
            raise ValueError(f"way must be one of {', '.join(WAYS)}, as a constant")
        return AnalyzeResult(StructType([StructField("ordinal", IntegerType()), StructField("piece", StringType()), *WAYS[way.value]]))

    def eval(self, text: str | None, way: str, size: int = 50):
        if text is None:
            return
        if way == "words":
            words = text.split()
            for i in range(0, len(words), size):
                part = words[i : i + size]
                yield i // size, " ".join(part), len(part)
        elif way == "line":
            yield from enumerate(text.split("\n"))
        else:
            for i, part in enumerate(p for p in text.split("\n\n") if p.strip()):
                yield i, part, part.count("\n") + 1


def register(spark: SparkSession) -> None:
    """Make `pieces(text, way[, size])` known to SQL: SELECT d.doc_id, p.* FROM docs d, LATERAL pieces(d.text, 'line') p."""
    spark.udtf.register("pieces", udtf(_Pieces))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def scored(rows: DataFrame, scorer: Scorer, question: str = "question", content: str = "content") -> DataFrame:
    """Rows with rerank_score: what `scorer` gives for a batch of questions and texts; null texts have the score of an empty one.

    The scorer runs in the tasks, an Arrow batch at a time; a model that is
    loaded at its first call stays with the worker.
    """
    schema = StructType([*rows.schema.fields, StructField("rerank_score", DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(rerank_score=scorer(batch[question].fillna(""), batch[content].fillna("")).astype("float64").to_numpy())

    return rows.mapInPandas(work, schema)


def reranked_by(rows: DataFrame, scorer: Scorer, weight: float = 0.7, top_k: int = 10, question: str = "question", content: str = "content") -> DataFrame:
    """Candidates (query_id, score, rank, question, content) reranked by a scorer of the user's."""
    return reranked(scored(rows, scorer, question, content), weight, top_k)
