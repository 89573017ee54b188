"""WARC archives with revisit resolution.

Headers (id, payload digest, length) are shuffled by digest; every record but one
of those with equal payloads becomes a revisit of it. Archives are written by
Spark's own text writer, record after record, and read back by content length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, stash

CRLF = "\r\n"
#: (payload bytes up to, records a file): a file has some 128 MB before compression, or one record.
FILES = ((1 << 16, 2000), (1 << 20, 128), (1 << 24, 8), (1 << 62, 1))
READ = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARSED = "id long, record_type string, uri string, digest_said string, refers_to_said long, payload binary"


def resolve_revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """`headers` (id, digest, bytes) with record_type and refers_to.

    Of records with equal digest and at least min_bytes, the one with the
    largest id is the response, the others revisit it. Smaller ones are all
    responses. Rows that repeat the largest id are all responses; a null id is
    less than any other, and a group without any other id is all responses.
    """
    firsts = stash(headers.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "originals")
    joined = headers.join(firsts, ["digest", "bytes"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    return joined.select("id", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def _record_id(page_id: Column) -> Column:
    d = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    at = lambda i, n: F.substring(d, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("3"), at(14, 3)), F.concat(F.lit("8"), at(18, 3)), at(21, 12)), F.lit(">"))


def warc_records(pages: DataFrame, decided: DataFrame, id_col: str, url_col: str, payload_col: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One string column `record`: fresh headers, then the payload for responses alone."""
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload")).withColumn("_sha", F.sha1(F.col("_payload").cast("binary")))
    rows = rows.join(decided, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_sha") == F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    response = F.col("record_type") == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.octet_length(http) + F.when(response, F.col("bytes")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("_url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("X-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))),
        line("X-Page", F.coalesce(F.col("id").cast("string"), F.lit(""))), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(header, http, F.when(response, F.col("_payload")).otherwise(""), F.lit(CRLF)).alias("record"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> None:
    """Write gzip-compressed WARC 1.1 files under `path`, a record per row, copies as revisits.

    Payloads are in UTF-8; null counts as empty. A null url is written empty;
    white space and control characters in one become %20. Rows that repeat both
    id and payload are written once each, under one record id. No rows give an
    empty folder. Records are written by the class of their payload's size (FILES), each
    class with so many records a file that no file holds more than some 128 MB, but
    for a single longer record; a class that has no records is passed over.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    headers = pages.select(F.col(id_col).alias("id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    decided = resolve_revisits(headers, min_bytes)
    # Repeated rows meet themselves in the join; the count of rows is restored by numbering them alike.
    decided = decided.distinct()
    size, below = F.octet_length(payload), 0
    there = headers.agg(*[F.max((F.col("bytes") > low) & (F.col("bytes") <= most)) for (low, _), (most, _) in zip(((-1, 0), *FILES), FILES)]).first()
    for (most, records_per_file), some in zip(FILES, there):
        if some or not below:
            own = pages.where((size > below if below else F.lit(True)) & (size <= most))
            records = warc_records(own, decided.where((F.col("bytes") > below if below else F.lit(True)) & (F.col("bytes") <= most)), id_col, url_col, payload_col)
            # Each record ends in CRLF, and so does each line that the writer adds: two of them close a record.
            records.write.mode("append").option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", records_per_file).text(path)
        below = most


def _inflated(data: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a piece at a time."""
    inflate, at = zlib.decompressobj(31), 0
    while at < len(data):
        piece = data[at : at + READ]
        at += len(piece)
        while len(piece):
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed stream."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("a record's header doesn't end")
        lines = held[:end].decode().split(CRLF)
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        size = int(fields["content-length"])
        if not need(end + 4 + size + 4):
            raise ValueError("a record is cut short")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_warc(_inflated(memoryview(content.as_buffer()))):
                    said = lambda k: int(fields[k]) if fields.get(k) else None
                    kind = fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    yield {"id": said("x-page"), "record_type": kind, "uri": fields["warc-target-uri"], "digest_said": fields["warc-payload-digest"].partition(":")[2], "refers_to_said": said("x-refers-to-page"), "payload": payload}

    held, size = [], 0
    for row in rows():
        held.append(row)
        size += len(row["payload"] or b"")
        if size > READ << 2 or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


_ARROW = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("digest_said", pa.string()), ("refers_to_said", pa.int64()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under `path`, payloads as they stand there (null for revisits).

    Files are bounded by the number of records that the writer puts in one for their size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_files, _PARSED)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read records.

    Digest and length come from the payloads read; a revisit takes those of the
    response whose payload has the digest that the revisit names.
    """
    heads = stash(records.select("id", "record_type", "digest_said", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha")), "heads")
    same = ["id", "bytes", "sha", "record_type"]
    own = heads.where("record_type = 'response'").select(*same, F.lit(None).cast("long").alias("refers_to"))
    originals = heads.where("record_type = 'response'").groupBy(F.col("sha").alias("digest_said")).agg(F.max("id").alias("refers_to"), F.max("bytes").alias("bytes"))
    originals = stash(originals.join(heads.where("record_type = 'revisit'").select("digest_said").distinct(), "digest_said", "left_semi"), "originals")
    revisits = heads.where("record_type = 'revisit'").drop("bytes", "sha").join(originals, "digest_said").select("id", "bytes", F.col("digest_said").alias("sha"), "record_type", "refers_to")
    return own.unionByName(revisits).select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write `pages` as archives, read them back, and resolve the revisits."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/docloom-warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **names)
    return resolved(read_warc(spark, path))

