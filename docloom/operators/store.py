"""Snapshots and changes: upserts by content hash, soft deletes, merges, incremental sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], *order, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def upsert_status(current: DataFrame, staged: DataFrame, key: str = "source_url", digest: str = "content_hash") -> DataFrame:
    """key, status of each staged row: new, updated or unchanged; of current rows with one key the latest id counts."""
    now = latest(current, key, F.desc("id")).select(key, F.col(digest).alias("_old"))
    joined = staged.join(now, key, "left")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(digest), "unchanged").otherwise("updated")
    return joined.withColumn("status", status).drop("_old")


def upserted(current: DataFrame, staged: DataFrame, key: str = "source_url", digest: str = "content_hash") -> DataFrame:
    """The next snapshot: changed and new rows from `staged`, all others from `current`."""
    changed = upsert_status(current, staged, key, digest).where("status != 'unchanged'").drop("status")
    return current.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def first_of_each(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return latest(rows, keys, *order)


def deactivated(chunks: DataFrame, documents: Column) -> DataFrame:
    """Chunks with is_active off where the condition holds."""
    return chunks.withColumn("is_active", F.col("is_active") & ~documents)


def missing_sections(documents: DataFrame, current: DataFrame, chunks: DataFrame, key: str = "source_url") -> DataFrame:
    """Stored documents whose key is not among the current ones, with the number of chunks to deactivate; none without any."""
    gone = documents.join(current.select(key).distinct(), key, "left_anti")
    active = chunks.where("is_active").groupBy("document_id").agg(F.count(F.lit(1)).alias("deactivated"))
    return gone.join(active, gone["id"] == active["document_id"]).select(key, "deactivated")


def inserted(existing: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """The rows of `new` to insert: the first of each key that is not there yet."""
    return latest(new, keys, *order).join(existing.select(*keys), keys, "left_anti")


def merged(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """`target` with matched rows replaced and others inserted."""
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def deleted(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def to_embed(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Active chunks whose content is not embedded yet."""
    return chunks.where("is_active").join(embedded.select("content_hash"), "content_hash", "left_anti")


def to_remove(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Inactive chunks that are still embedded."""
    return chunks.where("not is_active").join(embedded.select("chunk_id"), "chunk_id", "left_semi")


def searchable(content: Column, citation: Column, heading: Column) -> Column:
    """`[citation] heading` and a newline before the content, where either is given."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    head = F.concat_ws(" ", F.when(some(citation), F.concat(F.lit("["), citation, F.lit("]"))), F.when(some(heading), heading))
    return F.when(head == "", content).otherwise(F.concat(head, F.lit("\n"), content))


def sessions(turns: DataFrame, key: str, order: str, mode: str, at: str) -> DataFrame:
    """One row per session: the greatest turn, the first mode, first and last time."""
    return turns.groupBy(key).agg(F.max(order).alias("turn_count"), F.min_by(mode, order).alias("mode"), F.min(at).alias("created_at"), F.max(at).alias("last_active_at"))


def with_parent(rows: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the parent has, rows to reject)."""
    return rows.join(parent.select(key), key, "left_semi"), rows.join(parent.select(key), key, "left_anti")


def file_states(files: DataFrame) -> DataFrame:
    """Extracted files (text, error) with status ready or error, the digest of the trimmed text, and edits.

    edited_text is the text where nothing was edited; is_edited says whether both differ.
    """
    edited = F.coalesce("edited_text", "text")
    return files.withColumns({"status": F.when(F.col("error").isNotNull(), "error").otherwise("ready"), "text_hash": F.sha2(F.trim("text"), 256), "edited_text": edited, "is_edited": ~edited.eqNullSafe(F.col("text"))})


def next_order(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Per group the next place: one past the greatest, 0 where there is none."""
    return rows.groupBy(by).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))
