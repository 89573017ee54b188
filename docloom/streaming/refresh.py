"""Incremental refresh: staged documents go through upsert, chunking and embedding, batch by batch; a batch that runs twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash, estimate_tokens
from docloom.operators import store
from docloom.operators.shared import written

_DOCUMENTS = "bucket int, source_url string, id long, text string, content_hash string"
_CHUNKS = "bucket int, source_url string, chunk_id long, chunk_index int, content string, content_hash string, token_count int, is_active boolean"
_EMBEDDED = "bucket int, source_url string, chunk_id long, content_hash string, vector array<float>"
_LEDGER = "batch long, buckets array<int>, new long, updated long, unchanged long, embedded long, removed long"

_SCHEMAS = {"documents": _DOCUMENTS, "chunks": _CHUNKS, "embedded": _EMBEDDED}


def lines(documents: DataFrame) -> DataFrame:
    """Documents (source_url, text) as chunks: a line that is not blank is one."""
    each = documents.select("bucket", "source_url", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return each.where(F.trim("content") != "")


@dataclass
class Refresh:
    """documents, chunks and embedded under `path`, by bucket of the address, each bucket in the version of the last batch that touched it.

    A batch reads the versions that were committed before it, writes those of the
    buckets that it touches, and is then entered in the ledger, which is what
    commits it. A batch that is in the ledger is passed over; one that broke off
    before is done again over whatever it left. `split` makes chunks of documents,
    `embed` vectors of chunks (content to vector). Of rows of a batch with one
    address the last text by `order` counts.
    """

    path: str
    embed: Callable[[DataFrame], DataFrame]
    split: Callable[[DataFrame], DataFrame] = lines
    buckets: int = 16
    order: str = "at"

    def ledger(self, spark: SparkSession) -> list:
        """The committed batches in order, a row each."""
        try:
            rows = spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger/*")
        except Exception as error:  # nothing yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(rows.collect(), key=lambda r: r["batch"])

    def table(self, spark: SparkSession, name: str, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of documents, chunks or embedded after all committed batches, or those before one."""
        schema = _SCHEMAS[name]
        version = {b: r["batch"] for r in self.ledger(spark) if before is None or r["batch"] < before for b in r["buckets"]}
        paths = [f"{self.path}/{name}/{v}/bucket={b}" for b, v in sorted(version.items()) if only is None or b in only]
        if not paths:
            return spark.createDataFrame([], schema)
        # The folder of a bucket holds its rows without the bucket's number.
        plain = schema.replace("bucket int, ", "")
        rows = spark.read.schema(plain).parquet(*paths)
        return self._in_buckets(rows).select(*[c.split()[0] for c in schema.split(", ")])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of staged rows (source_url, text and the order's column): the function for foreachBatch."""
        spark = batch.sparkSession
        if any(r["batch"] == batch_id for r in self.ledger(spark)):
            return
        staged = store.latest(batch.where("source_url is not null").select("source_url", "text", self.order), "source_url", F.desc(self.order), F.desc("text"))
        staged = staged.select("source_url", F.xxhash64("source_url").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        # The status comes by the shuffle that finds the last text, so texts are moved once.
        staged = store.upsert_status(self.table(spark, "documents", batch_id), staged.withColumn("content_hash", content_hash(F.col("text"))))
        staged = written(self._in_buckets(staged).withColumn("text", F.when(F.col("status") != "unchanged", F.col("text"))), "staged")
        found = staged.groupBy("bucket", "status").count().collect()
        touched = sorted({r["bucket"] for r in found})
        counts = {s: sum(r["count"] for r in found if r["status"] == s) for s in ("new", "updated", "unchanged")}
        old = {name: self.table(spark, name, batch_id, touched) for name in ("documents", "chunks", "embedded")}
        changed = staged.where("status != 'unchanged'").drop("status")

        self._write(store.merged(old["documents"], changed.select(*old["documents"].columns), "source_url"), "documents", batch_id, touched)
        # Chunks of what changed: the old ones are switched off, those of the new text are inserted or switched on. What
        # happens to an old one is found by its keys, so that contents are moved once; digests are made again, not moved.
        fresh = self.split(changed).select("bucket", "source_url", F.xxhash64("source_url", "chunk_index", "content").alias("chunk_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "content", estimate_tokens(F.col("content")).cast("int").alias("token_count"), F.lit(True).alias("is_active"))
        stale = old["chunks"].select("source_url", "chunk_id").join(changed.select("source_url"), "source_url", "left_semi")
        marks = stale.select("chunk_id", F.lit(False).alias("_again")).unionByName(fresh.select("chunk_id", F.lit(True).alias("_again"))).groupBy("chunk_id").agg(F.bool_or("_again").alias("_again"))
        before = store.deactivated(old["chunks"].join(marks, "chunk_id", "left").where("not coalesce(_again, false)"), F.col("_again").isNotNull())
        hashed = lambda rows: rows.withColumn("content_hash", content_hash(F.col("content")))
        chunks = self._write(hashed(before.select(*fresh.columns).unionByName(fresh)), "chunks", batch_id, touched)
        removed = store.to_remove(chunks, old["embedded"]).select("chunk_id")
        kept = store.deleted(old["embedded"], removed, "chunk_id")
        # A text that is embedded in this address already is not embedded again. Only fresh chunks lack a vector, unless an
        # earlier batch got fewer than it asked for.
        lacking = written(chunks.where("is_active").select("chunk_id").join(kept.select("chunk_id"), "chunk_id", "left_anti"), "lacking")
        missing = fresh.join(kept.select("chunk_id"), "chunk_id", "left_anti")
        n_missing = lacking.count()
        if n_missing > missing.count():
            missing = chunks.where("is_active").join(lacking, "chunk_id", "left_semi")
        vectors = self.embed(hashed(missing)).select("bucket", "source_url", "chunk_id", "content_hash", F.col("vector").cast("array<float>").alias("vector"))
        self._write(kept.select(*vectors.columns).unionByName(vectors), "embedded", batch_id, touched)
        facts = (batch_id, touched, *counts.values(), n_missing, removed.count())
        spark.createDataFrame([facts], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch_id}")

    def _in_buckets(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("source_url"), self.buckets).cast("int"))

    def _write(self, rows: DataFrame, name: str, batch_id: int, touched: list[int]) -> DataFrame:
        """A batch's version of a table, from the tasks that have its rows, and read again."""
        path = f"{self.path}/{name}/{batch_id}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        read = rows.sparkSession.read.schema(_SCHEMAS[name])
        self._fill(rows.sparkSession, name, batch_id, touched, read.parquet(path))
        return read.parquet(path)

    def _fill(self, spark: SparkSession, name: str, batch_id: int, touched: list[int], rows: DataFrame) -> None:
        """Buckets that the batch left without rows get an empty file, so that every version of the ledger can be read."""
        there = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for bucket in set(touched) - there:
            schema = _SCHEMAS[name].replace("bucket int, ", "")
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/{batch_id}/bucket={bucket}")

    def start(self, staged: DataFrame, checkpoint: str):
        """All staged rows there are, in micro-batches; what was applied before is not applied again."""
        return staged.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
