"""An inverted-file index of vectors: every vector lies in the cell of its nearest centroid; questions read few cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.retrieval import nearest_of, ranked
from docloom.operators.shared import written

#: Vectors that centroids are fitted on: those with the least hashes of their ids. All that reaches the driver.
SAMPLE_ROWS = 20_000
#: Centroids at most; they go to every task.
MOST_CELLS = 4096
#: Vectors of the sample that are asked for their NEIGHBOURS nearest, to see how many cells must be read for the wanted recall.
TRIALS, NEIGHBOURS = 500, 50
#: Vectors of a cell's shard at most, before it is split; of a written block; questions of a block.
SHARD_ROWS, BLOCK_ROWS, BLOCK_QUESTIONS = 65_536, 4096, 1024
#: Rows that a task makes at once of vectors and the cells that they go to.
CELL_ROWS = 16_384

_CELLS = "cell int, id long, vector array<float>"
_BLOCKS = "cell int, shard int, ids binary, rows binary"
_NEAR = "query_id long, id long, similarity double"


@dataclass
class VectorIndex:
    """centroids (cells x width, unit length), shards of each cell, cells that a question reads, and the written table of blocks by cell."""

    path: str
    centroids: np.ndarray
    shards: dict[int, int] = field(default_factory=dict)
    probes: int = 1

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_BLOCKS).parquet(f"{self.path}/cells")

    def vectors(self, spark: SparkSession) -> DataFrame:
        """cell, id, vector of all that is in the index."""
        width = self.centroids.shape[1]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, ids, rows in zip(*(batch.column(c).to_pylist() for c in ("cell", "ids", "rows"))):
                    own, flat = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.float32)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(np.full(len(own), cell, np.int32)), "id": pa.array(own), "vector": pa.FixedSizeListArray.from_arrays(pa.array(flat), width).cast(pa.list_(pa.float32()))})

        return self.blocks(spark).mapInArrow(unpack, _CELLS)

    def save(self, spark: SparkSession) -> None:
        """What is not in the table, beside it."""
        facts = json.dumps({"shards": self.shards, "probes": self.probes, "centroids": self.centroids.tolist()})
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{self.path}/facts")


def load(spark: SparkSession, path: str) -> VectorIndex:
    facts = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()[0])
    return VectorIndex(path, np.array(facts["centroids"], np.float64), {int(k): v for k, v in facts["shards"].items()}, facts["probes"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell takes the vector that its centroid fits worst."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = sample @ centers.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[empty] = sample[np.argsort(near[np.arange(len(own)), own], kind="stable")[: len(empty)]]
        moved = _unit(sums)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The least number of nearest cells in which TRIALS vectors of the sample find `recall` of their nearest others there."""
    asked = sample[:TRIALS]
    own = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    top = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _in_cells(rows: DataFrame, name: str, centroids: np.ndarray, cells: int) -> DataFrame:
    """cell, id, vector: a row for each of the `cells` nearest centroids of a vector, CELL_ROWS at a time; null vectors are left out."""
    step = max(1, CELL_ROWS // max(cells, len(centroids) // 8))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                near = _unit(_matrix(part.column("vector"))) @ centroids.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :cells] if cells < len(centroids) else np.tile(np.arange(len(centroids)), (len(near), 1))
                row = np.repeat(np.arange(len(near)), best.shape[1])
                yield pa.RecordBatch.from_pydict({"cell": pa.array(best.ravel().astype(np.int32)), "id": part.column("id").take(pa.array(row)), "vector": part.column("vector").take(pa.array(row))})

    some = rows.select(F.col(name).cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).where("vector is not null")
    return some.mapInArrow(work, _CELLS)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (cell, shard, id, vector) in blocks of up to `size`, by cell and shard."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"cell": pa.array([key[0]], pa.int32()), "shard": pa.array([key[1]], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "rows": [np.concatenate(vectors).tobytes()]})

        for batch in batches:
            flat = _matrix(batch.column("vector")).astype(np.float32)
            for i, (cell, shard, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "shard", "id")))):
                if ids and ((cell, shard) != key or len(ids) >= size):
                    yield block()
                    ids, vectors = [], []
                key = (cell, shard)
                ids.append(own)
                vectors.append(flat[i])
        if ids:
            yield block()

    return rows.repartition("cell", "shard").sortWithinPartitions("cell", "shard", "id").mapInArrow(pack, _BLOCKS)


def _sharded(rows: DataFrame, shards: dict[int, int]) -> DataFrame:
    """Rows with the shard of their cell that the id's hash gives; cells of one shard are not named."""
    many = F.coalesce(*[F.when(F.col("cell") == c, n) for c, n in shards.items()], F.lit(1)) if shards else F.lit(1)
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), many).cast("int"))


def _shards_of(cells: DataFrame) -> dict[int, int]:
    """Cells that need more than one shard: a count for each cell, MOST_CELLS at most."""
    return {r["cell"]: -(-r["count"] // SHARD_ROWS) for r in cells.groupBy("cell").count().where(F.col("count") > SHARD_ROWS).collect()}


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 0, recall: float = 0.95) -> VectorIndex:
    """Index `vectors` (id, vector) at `path`; what was there is replaced.

    Centroids are fitted on SAMPLE_ROWS vectors at most (the least hashes of ids);
    every vector is then written to the cell of its nearest one. `cells` is the
    square root of the number of vectors by default, MOST_CELLS at most. A cell of
    more than SHARD_ROWS vectors is split by the ids' hashes. How many cells a
    question reads is fitted too: as many as vectors of the sample need to find
    `recall` of their nearest in the sample (few where vectors cluster, most where
    they are spread evenly). All vectors must be of
    one width, and are kept as floats; null ones are left out. No vectors give an index that finds nothing.
    """
    spark = vectors.sparkSession
    some = vectors.where("vector is not null")
    count = some.count()
    sample = some.select(F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()["vector"]
    rows = _unit(np.array(sample.tolist(), np.float64)) if count else np.zeros((1, 1))
    wanted = min(cells or max(1, round(count**0.5)), MOST_CELLS, len(rows))
    index = VectorIndex(path, fit_centroids(rows, wanted, seed=seed))
    index.probes = probes_for(rows, index.centroids, recall)
    placed = written(_in_cells(vectors, "id", index.centroids, 1), "cells")
    index.shards = _shards_of(placed)
    _packed(_sharded(placed, index.shards), BLOCK_ROWS).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    index.save(spark)
    return index


def update(index: VectorIndex, spark: SparkSession, changed: DataFrame | None = None, removed: DataFrame | None = None) -> VectorIndex:
    """Insert or replace `changed` (id, vector) and delete `removed` (id), rewriting the touched cells only.

    A cell is touched if a changed or removed id lies in it, or goes there; the
    ids of all blocks are read, vectors of touched cells alone. Of an id that is
    changed and removed, the change holds. Running it again changes nothing.
    """
    none = spark.createDataFrame([], _CELLS)
    new = written(_in_cells(changed, "id", index.centroids, 1), "changed") if changed is not None else none
    gone = new.select("id")
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col("id").cast("long").alias("id")))
    gone = written(gone.distinct(), "gone")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids in zip(batch.column("cell").to_pylist(), batch.column("ids").to_pylist()):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.full(len(own), cell, np.int32)), "id": pa.array(own)})

    places = index.blocks(spark).select("cell", "ids").mapInArrow(ids_of, "cell int, id long")
    touched = sorted(r["cell"] for r in places.join(gone, "id", "left_semi").select("cell").unionByName(new.select("cell")).distinct().collect())
    if not touched:
        return index
    old = VectorIndex(index.path, index.centroids)
    stay = old.vectors(spark).where(F.col("cell").isin(touched)) if len(touched) < len(index.centroids) else old.vectors(spark)
    rows = written(stay.join(gone, "id", "left_anti").unionByName(new.select("id", "cell", "vector"), allowMissingColumns=True).select("cell", "id", "vector"), "rows")
    sizes = _shards_of(rows)
    index.shards = {c: n for c, n in index.shards.items() if c not in touched} | sizes
    blocks = _packed(_sharded(rows, sizes), BLOCK_ROWS)
    # A cell that is left empty keeps one block without vectors, so that its old one goes.
    filled = written(blocks, "blocks")
    empty = spark.createDataFrame([(c,) for c in touched], "cell int").join(filled.select("cell").distinct(), "cell", "left_anti")
    filled = filled.unionByName(empty.select("cell", F.lit(0).alias("shard"), F.lit(b"").alias("ids"), F.lit(b"").alias("rows")))
    filled.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{index.path}/cells")
    index.save(spark)
    return index


def search(index: VectorIndex, queries: DataFrame, top_k: int = 50, probes: int | None = None) -> DataFrame:
    """query_id, id, similarity (cosine), rank: the top_k of the `probes` nearest cells for each of `queries` (query_id, vector).

    `probes` is what the build found by default; with all cells the result is
    exact. Questions go to their cells by a shuffle and are packed there,
    every shard of a cell gets them, and a matrix product is taken for each block of
    questions and block of vectors; what leaves a task is a question's top_k of a
    block. Ties go to the lesser id.
    """
    spark, width = queries.sparkSession, index.centroids.shape[1]
    probes = probes or index.probes
    routed = _in_cells(queries.withColumnRenamed("query_id", "id"), "id", index.centroids, probes).withColumn("shard", F.lit(0))
    asked = _packed(routed, BLOCK_QUESTIONS)
    if index.shards:
        many = F.coalesce(*[F.when(F.col("cell") == c, n) for c, n in index.shards.items()], F.lit(1))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), many - 1)))
    asked = asked.select("cell", "shard", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_rows, ids, rows = (batch.column(c)[i].as_buffer() for c in ("q_ids", "q_rows", "ids", "rows"))
                asked, own = (_unit(np.frombuffer(x, np.float32).reshape(-1, width).astype(np.float64)) for x in (q_rows, rows))
                yield nearest_of(np.frombuffer(q_ids, np.int64), asked, np.frombuffer(ids, np.int64), own, top_k)

    blocks = index.blocks(spark).where(F.octet_length("ids") > 0)
    near = blocks.join(asked, ["cell", "shard"]).mapInArrow(best, _NEAR)
    return ranked(near, F.desc("similarity"), "id").where(F.col("rank") <= top_k)
