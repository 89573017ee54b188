"""An append-only log of changes to sources and runs, its state at any time, and snapshots that shorten the replay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class ChangeLog:
    """Changes of rows with `key` and the columns of `schema` (which has the key), under `path`.

    A change has seq (its place among all changes; no two alike), the key, gone
    (whether the row is deleted), names (the columns that it sets) and their
    values. The last writer of each column counts; what was set before a row was
    deleted is forgotten.
    """

    path: str
    key: str
    schema: StructType

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema if f.name != self.key]

    def _entries(self) -> StructType:
        return StructType([StructField("seq", LongType()), StructField("gone", BooleanType()), StructField("names", ArrayType(StringType())), *self.schema.fields])

    def append(self, changes: DataFrame) -> None:
        """Write `changes` (seq, key, and any of gone, names and columns) behind the others; without names, all columns given are set."""
        given = [c for c in self.columns if c in changes.columns]
        names = F.col("names") if "names" in changes.columns else F.array(*[F.lit(c) for c in given]).cast("array<string>")
        gone = F.coalesce("gone", F.lit(False)) if "gone" in changes.columns else F.lit(False)
        values = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        changes.select(F.col("seq").cast("long").alias("seq"), gone.alias("gone"), names.alias("names"), *values).write.mode("append").parquet(f"{self.path}/log")

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._entries()).parquet(f"{self.path}/log")

    def versions(self, spark: SparkSession) -> list[int]:
        """The seqs of the snapshots, ascending; a snapshot counts once its mark is written."""
        try:
            marks = spark.read.schema("version long").parquet(f"{self.path}/marks")
        except Exception as error:  # no snapshot yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(r["version"] for r in marks.distinct().collect())

    def state(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The rows as they are after the change `upto` (all changes, by default): the last snapshot before it and the changes since."""
        since = [v for v in self.versions(spark) if upto is None or v <= upto]
        changes = self.log(spark)
        if upto is not None:
            changes = changes.where(F.col("seq") <= upto)
        if since:
            version = since[-1]
            old = spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/{version}")
            start = old.select(F.lit(version).cast("long").alias("seq"), F.lit(False).alias("gone"), F.array(*map(F.lit, self.columns)).alias("names"), *[f.name for f in self.schema])
            changes = changes.where(F.col("seq") > version).unionByName(start)
        return self.replayed(changes)

    def replayed(self, changes: DataFrame) -> DataFrame:
        """The rows that a set of changes leads to: one pre-aggregated group a key."""
        last_gone = F.max(F.when(F.col("gone"), F.col("seq")))
        # A column's last writer, and a deletion as a writer of nothing to all columns.
        sets = lambda c: F.col("gone") | F.array_contains("names", c)
        value = lambda c: F.max_by(F.struct(F.when(~F.col("gone"), F.col(c)).alias("v")), F.when(sets(c), F.col("seq"))).alias(f"_{c}")
        found = changes.groupBy(self.key).agg(F.max("seq").alias("_last"), last_gone.alias("_gone"), *[value(c) for c in self.columns])
        there = found.where(F.col("_gone").isNull() | (F.col("_last") > F.col("_gone")))
        return there.select(*[F.col(f.name) if f.name == self.key else F.col(f"_{f.name}.v").alias(f.name) for f in self.schema])

    def compact(self, spark: SparkSession) -> int | None:
        """Write the present state as a snapshot named by the last seq, and then its mark; done again, it is the same."""
        last = self.log(spark).agg(F.max("seq")).first()[0]
        if last is not None and last not in self.versions(spark):
            self.state(spark, last).write.mode("overwrite").parquet(f"{self.path}/snapshots/{last}")
            spark.createDataFrame([(last,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        return last


def runs_started(rows: DataFrame, seq: Column, run: Column, source: Column, at: Column) -> DataFrame:
    """Changes that open runs: source, start, status running, an empty summary."""
    return rows.select(seq.alias("seq"), run.alias("run_id"), source.alias("source_id"), at.alias("started_at"), F.lit("running").alias("status"), F.lit("{}").alias("summary"))


def runs_completed(rows: DataFrame, seq: Column, run: Column, at: Column, status: Column, summary: Column) -> DataFrame:
    """Changes that close runs: end, status and summary; source and start stay."""
    return rows.select(seq.alias("seq"), run.alias("run_id"), at.alias("completed_at"), status.alias("status"), summary.alias("summary"))
