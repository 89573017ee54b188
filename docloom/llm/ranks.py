"""Places in an order, by sorted parts and the counts before them: no task sees more than its part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import partitions, stash


def placed(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """`rows` with position (0, 1, 2... within its group by `order`) and total (the group's rows), both long.

    Rows are dealt by ranges of groups and order, so a large group lies in many
    parts; the sorted parts are written, each part's rows of a group counted,
    and the counts before it (one a part and group) added to the place within
    the part. Null is a group of its own. Rows equal in `order` are placed in
    some order: name all that the result depends on. Columns of the names
    position, total, _at, _part, _first and _before are replaced.
    """
    keys = [F.col(g) for g in groups]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    ordered = stash(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    all_parts = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.withColumns({"_before": before, "total": F.sum("_n").over(all_parts)})
    renamed = parts.select(*[F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)], F.col("_part").alias("_of_part"), "_first", "_before", "total")
    same = F.col("_part") == F.col("_of_part")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{i}"))
    joined = ordered.drop("total", "position").join(renamed, same)
    return joined.withColumn("position", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_of_part", "_first", "_before", *[f"_of_{i}" for i in range(len(groups))])
