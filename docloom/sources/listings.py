"""Listings of numbered pages (JSON, one file a page) as a data source: read at once in parallel, or as a stream that goes on where it was."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_SCHEMA = "page int, ordinal int, item string, retry_after double"
_FILE = re.compile(r"page-(\d+)\.json$")


def _files(path: str) -> tuple:
    """The file system and the pages of a folder: (number, file name), in order."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = [(int(m[1]), f.path) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if (m := _FILE.search(f.path))]
    return system, sorted(found)


def _rows(path: str, pages: list[int]) -> Iterator[tuple]:
    system, found = _files(path)
    names = dict(found)
    for page in pages:
        if page not in names:
            continue
        with system.open_input_stream(names[page]) as stream:
            body = json.loads(stream.read())
        if body.get("retry_after") is not None:
            yield page, -1, None, float(body["retry_after"])
        for i, item in enumerate(body.get("results") or []):
            yield page, i, json.dumps(item), None


class _Pages(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


def _parts(pages: list[int], size: int) -> list[_Pages]:
    return [_Pages(pages[i : i + size]) for i in range(0, len(pages), size)] or [_Pages([])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pagesAPartition", 10))

    def partitions(self) -> list[_Pages]:
        return _parts([n for n, _ in _files(self.path)[1]], self.size)

    def read(self, partition: _Pages) -> Iterator[tuple]:
        yield from _rows(self.path, partition.pages)


class _StreamReader(DataSourceStreamReader):
    """The offset is the number of the next page; pages come in order, so those below it are known."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pagesAPartition", 10))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        found = _files(self.path)[1]
        return {"page": found[-1][0] + 1 if found else 0}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        return _parts([n for n, _ in _files(self.path)[1] if start["page"] <= n < end["page"]], self.size)

    def read(self, partition: _Pages) -> Iterator[tuple]:
        yield from _rows(self.path, partition.pages)

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """`listing`: page, ordinal, item (JSON) of the results of every page under `path` (page-0.json, page-1.json...), pagesAPartition at a time.

    A page that was put off has a row with retry_after seconds, ordinal -1 and no
    item. A page without results has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)


def put_off(rows: DataFrame, tried_at: str = "tried_at") -> DataFrame:
    """page, due: pages whose last try was put off, and when they may be tried again; rows have the time of the try."""
    last = Window.partitionBy("page").orderBy(F.desc(tried_at), F.desc_nulls_last("retry_after"))
    tries = rows.select("page", tried_at, "retry_after").withColumn("_n", F.row_number().over(last)).where("_n = 1 and retry_after is not null")
    return tries.select("page", F.timestamp_add("SECOND", F.col("retry_after").cast("int"), F.col(tried_at)).alias("due"))
