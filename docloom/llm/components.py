"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import dropped, gathered, stash


def _downward(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node."""
    return links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _neighbourhood(edges: DataFrame, little: int) -> DataFrame:
    """u, the least of it and its neighbours, and its numbers of links to smaller and to larger nodes."""
    edges = gathered(edges, little)
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.v")
    least = F.least(F.min("v"), F.col("u")).alias("least")
    return stash(both.groupBy("u").agg(least, F.count_if(F.expr("v < u")).alias("below"), F.count_if(F.expr("v > u")).alias("above")), "least")


def _step(edges: DataFrame, least: DataFrame, little: int) -> DataFrame:
    """The links after a large and a small star, each once; the tables given are deleted."""
    # Large star: of every node, the larger neighbours move to the least of it and its neighbours.
    # (u > v) says all: u is a larger neighbour of v, and moves to v's least. Links may repeat until the step's end.
    large = gathered(edges, little).join(gathered(least, little).select(F.col("u").alias("at"), "least"), F.col("v") == F.col("at")).select("u", F.col("least").alias("v"))
    large = stash(large, "large")
    # Small star: the smaller neighbours of a node, and it, move to the least of them.
    down = stash(gathered(large, little).groupBy("u").agg(F.min("v").alias("least")), "least")
    small = gathered(large, little).join(gathered(down, little).withColumnRenamed("u", "at"), F.col("u") == F.col("at")).select("at", F.col("v").alias("u"), F.col("least").alias("v"))
    # A node's own link to its least comes with each of its links; the step's end makes them one.
    own = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("at").alias("u"), "v")))
    small = _downward(small.select(own.alias("e")).select("e.u", "e.v"))
    after = stash(small.distinct(), "links")
    dropped(edges, least, large, down)
    return after


def components(links: DataFrame, most_rounds: int = 60, little: int = 0) -> DataFrame:
    """node, component (its least node) for every node of `links` (u, v: longs, not null).

    Each step replaces a node's neighbours by links to its least neighbour. The
    least is found by a pre-aggregated minimum and joined back, so a node that
    has a third of all links is never gathered in one place: both sides of that
    join are shuffled tables whose large partitions Spark splits. The number of
    rounds grows with the logarithm of the longest chain. Tables of up to `little`
    bytes are taken by one task. No links give no rows.
    """
    edges = stash(_downward(links), "links")
    for _ in range(most_rounds):
        least = _neighbourhood(edges, little)
        # Settled links are stars: a node has larger neighbours alone, or one smaller neighbour alone.
        if least.where("below > 1 or (below = 1 and above > 0)").isEmpty():
            dropped(least)
            break
        edges = _step(edges, least, little)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
