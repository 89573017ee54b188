"""Walks over links, trees, and segments of ordered rows."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docloom.operators.shared import temporary


#: Nodes of a level up to which it is broadcast to the links; of more, both are shuffled.
SMALL_LEVEL = 100_000


def frontier(links: DataFrame, seeds: DataFrame, allowed: Column | None = None, most_levels: int | None = None) -> DataFrame:
    """node, level of what is reached from `seeds` (node) over `links` (src, dst), level by level.

    Each level is one join and one anti join with what was visited, and is
    written once, so neither the plan nor what is written again grows with the
    depth. It goes on until nothing new is found, or for `most_levels` where a
    crawl has such a limit.
    """
    spark = seeds.sparkSession
    edge = links.where(allowed) if allowed is not None else links
    edge = edge.select("src", F.col("dst").alias("node"))
    path = temporary(spark, "frontier")
    kind = StructType([seeds.select("node").union(edge.select("node")).schema["node"]])
    to = lambda level: f"{path}/level={level}"
    seeds.select(F.col("node").cast(kind["node"].dataType)).distinct().write.parquet(to(0))
    for level in count(0) if most_levels is None else range(most_levels):
        now = spark.read.schema(kind).parquet(to(level))
        n = now.count()
        if not n:
            break
        visited = spark.read.schema(StructType([*kind, StructField("level", IntegerType())])).parquet(path)
        reached(edge, now, visited, n <= SMALL_LEVEL).write.parquet(to(level + 1))
    return spark.read.schema(StructType([*kind, StructField("level", IntegerType())])).parquet(path)


def reached(edge: DataFrame, now: DataFrame, visited: DataFrame, small: bool) -> DataFrame:
    """The nodes that links (src, node) lead to from `now` and that were not visited; of all joined only a small `now` goes through the driver."""
    now = now.select(F.col("node").alias("_from"))
    found = edge.join(F.broadcast(now) if small else now.hint("merge"), edge["src"] == now["_from"]).select("node").distinct()
    return found.join(visited.select("node").hint("merge"), "node", "left_anti")


def kept(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut in the folder of spark.checkpoint.dir, or our own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint()


def tree_paths(nodes: DataFrame, most_depth: int = 1_000) -> DataFrame:
    """id, depth, path of a forest (id, parent, name): names from the root joined by ` > `; a deeper one than most_depth is an error."""
    level = nodes.where("parent is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out = level
    for depth in range(1, most_depth + 1):
        level = nodes.join(level.select(F.col("id").alias("_up"), F.col("path").alias("_path")), F.col("parent") == F.col("_up"))
        level = kept(level.select("id", F.lit(depth).alias("depth"), F.concat_ws(" > ", "_path", "name").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {most_depth}")


def segments(rows: DataFrame, by: str, order: str, starts: Column) -> DataFrame:
    """Rows with `segment`: how many starts have come so far; 0 before the first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def without_adjacent_repeats(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_before", before).where("_before is null or not (_before <=> {})".format(value)).drop("_before")


def spaced(positions: Column, gap: int = 20) -> Column:
    """Of ascending positions those at least `gap` after the last one that was kept."""
    empty = F.array().cast("array<long>")
    add = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc)
    return F.when(F.size(positions) == 0, empty).otherwise(F.aggregate(positions.cast("array<long>"), F.array(F.element_at(positions, 1).cast("long")), add))


def preferred_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both, without the rows of `second` whose key `first` has."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
