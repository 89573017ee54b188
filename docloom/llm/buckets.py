"""Whole texts in buckets: one exchange of them, which several steps of an operator read again.

Copies of a whole text are told by digest and sent to the buckets as a list, so
that an operator does the work for one row of them. Rows that repeat both id and
text are one row of a bucket with their number, counted before they are dealt.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import partitions, stash
from docloom.llm.packed import parts_for

#: Documents and bytes of a bucket, about; rows differ in id or text, so a hash keeps them below 2 ** 16 (packed.deal raises beyond).
BUCKET_DOCS, BUCKET_BYTES = 16_000, 3 << 20
#: Stands for a null id, which so is larger than any other.
NO_ID = (1 << 63) - 1


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(texts, copies, parts) of `docs`: key, bytes, rows, bucket of every distinct id and text; rows of packed.SCHEMA for copies; how many parts packed tokens go to.

    They go to buckets by a hash of id and text, as many as the bytes of all texts
    ask for; `rows` says how often an id and text occur. A copy is a row with the
    text of one with a smaller id; its blob has its key, the text's digest and
    that smallest id.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("deal", F.xxhash64("key", "bytes"))
    heads = stash(rows.select("key", "deal", F.octet_length("bytes").cast("long").alias("n"), F.unhex(F.sha2("bytes", 256)).alias("sha")), "heads")
    total = heads.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    buckets = max(total["docs"] // BUCKET_DOCS, total["n"] // BUCKET_BYTES) + 1
    bucket = F.pmod(F.col("deal"), F.lit(buckets)).cast("long")
    least = heads.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    least = stash(least, "least")
    raw = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    blob = F.concat(raw("key"), F.col("sha"), raw("least"))
    copies = heads.join(least, "sha").where("key > least").select(bucket.alias("chunk"), F.lit(-1).alias("part"), F.lit(True).alias("is_table"), blob.alias("blob")).distinct()
    # Where rows repeat, those that share a hash with a repeated one are counted before the exchange; mostly there are none.
    again = stash(heads.groupBy("deal").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("deal").alias("of")), "again")
    texts = rows.withColumn("rows", F.lit(1).cast("long"))
    if not again.isEmpty():
        some = rows.join(again, rows["deal"] == again["of"], "left_semi").groupBy("key", "bytes", "deal").agg(F.count(F.lit(1)).alias("rows"))
        texts = texts.join(again, texts["deal"] == again["of"], "left_anti").unionByName(some)
    return texts.select("key", "bytes", "rows", bucket.alias("bucket")), stash(copies, "copies"), parts_for(partitions(docs.sparkSession), total["n"])


def texts_of(table: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Keys and texts of a bucket's rows, by key and text, and how many rows each stands for."""
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "bytes", "rows"))))
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def each_row(cut: DataFrame) -> DataFrame:
    """`cut` with a row for each that it stands for, by its column `rows`."""
    return cut.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows")


def skipped(keys: list[int], texts: list[bytes], right: pa.Table) -> dict[int, int]:
    """The numbers of the texts that are copies, each with the smallest id that has its text."""
    of = lambda b: int.from_bytes(b, "big", signed=True)
    copies = {blob[:40]: of(blob[40:]) for kind, blob in zip(right.column("is_table").to_pylist(), right.column("blob").to_pylist()) if kind}
    known = {of(name[:8]) for name in copies}
    out = {}
    for i, key in enumerate(keys):
        if key in known:
            least = copies.get(int(key).to_bytes(8, "big", signed=True) + hashlib.sha256(texts[i]).digest())
            if least is not None:
                out[i] = least
    return out
