"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD_PATTERN, stash, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, half_shares: int = 3, half_cap: int = 4) -> DataFrame:
    """source, source_size, target for `sizes` (source, size).

    Sources in code-point order, null last, weigh `weights` in turn, and share
    half_shares / 2 of all sizes. A target stops at half_cap / 2 of its source's
    size and the excess is shared again by weight. That fixed point is found in
    one pass: by ascending size / weight, a source is at its cap as long as its
    cap is at most its share of what those before it leave. There is one row a
    source, so the windows hold few rows. All counts are exact integers.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1)))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    # In halves, to stay with integers.
    each = each.withColumn("cap", F.col("source_size") * half_cap).withColumn("total", F.sum("source_size").over(all_rows) * half_shares).withColumn("weights", F.sum("weight").over(all_rows))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    each = each.withColumn("capped", F.col("cap") * weight_left <= F.col("weight") * left)
    free = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows)
    free_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    target = F.when(F.col("capped"), F.col("cap") / 2).otherwise(F.col("weight") * free / (2 * F.when(free_weight > 0, free_weight)))
    return each.select("source", "source_size", target.alias("target"))


def sainte_lague(votes, seats: int, most) -> np.ndarray:
    """Seats for each entry: the highest quotients votes / 1, votes / 3, ... win.

    No entry gets more than its `most`. Ties go to the earlier entry. Entries
    start with what any divisor no smaller than the right one grants, which is
    never too much; at most about one seat an entry is left for the heap.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    got = np.zeros(len(votes), np.int64)
    total, spare = votes.sum(), seats - len(votes) / 2
    if spare > 0 and total > 0:
        got = np.minimum(np.floor(votes * spare / total + 0.5).astype(np.int64), most)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _apportion(votes: str, seats: str, most: str):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "shard"], na_position="last", kind="stable")
        rows["quota"] = sainte_lague(rows[votes], int(rows[seats].iloc[0]), rows[most]) if len(rows) else 0
        return rows

    return one


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, block_tokens: int = 64, shard_tokens: int = 1_000_000, seed: int = 17, key_col: str | None = None) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken, passes, first, last.

    size counts the words of the text (null: 0). A source is dealt to shards of
    about shard_tokens words by a seeded hash of the id, so the largest source
    is no larger a task than any other. Within a shard the documents stand in a
    seeded order and are cut into blocks of block_tokens words. Sources get whole
    blocks by highest quotients of their targets, and each source's shards by
    highest quotients of their sizes. A quota takes the whole shard `passes`
    times, and the rest of it from a seeded block onwards, round the end; of a
    document that rest takes the words from `first` to before `last`, which runs
    past its size where the run ends and starts in the same document (words then
    count from 0 again). taken is passes * size plus that rest.

    Rows with a null id are placed by their text. Empty documents get taken 0.
    Rows that repeat are separate rows; a `key_col` that tells them apart comes
    along. No rows give no rows.
    """
    keys = [F.col(key_col).alias("row_key")] if key_col else []
    # Rows without an id are told apart by their text, or all would fall into one shard.
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(0)
    sized = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), salt.alias("salt"), *keys), "sizes")
    targets = stash(source_targets(sized, weights), "targets")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1))
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)).bitwiseXOR(F.col("salt")), shards)).withColumn("order", F.xxhash64("id", F.lit(seed + 1)).bitwiseXOR(F.col("salt")))

    blocks = F.ceil(F.col("shard_size") / block_tokens)
    by_shard = stash(placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("target")), "shards")
    by_source = by_shard.groupBy("source").agg(F.first("target").alias("target"), (2 * F.sum(blocks)).alias("most"), F.lit(0).cast("long").alias("shard"))
    by_source = by_source.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens).cast("long"))
    quotas = by_source.groupBy("shard").applyInPandas(_apportion("target", "seats", "most"), "source string, target double, most long, shard long, seats long, quota long")
    quotas = stash(quotas.select(F.col("source").alias("of"), F.col("quota").alias("seats")), "quotas")
    shard_rows = by_shard.join(quotas, by_shard["source"].eqNullSafe(quotas["of"])).select("source", "shard", "shard_size", (2 * blocks).alias("most"), F.coalesce("seats", F.lit(0)).alias("seats"))
    dealt = shard_rows.groupBy("source").applyInPandas(_apportion("shard_size", "seats", "most"), "source string, shard long, shard_size long, most long, seats long, quota long")
    dealt = stash(dealt.select(F.col("source").alias("of"), F.col("shard").alias("of_shard"), "shard_size", "quota"), "dealt")

    in_shard = Window.partitionBy("source", "shard").orderBy("order", "id", "size", *(["row_key"] if keys else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(in_shard), F.lit(0)))
    placed = placed.join(dealt, placed["source"].eqNullSafe(dealt["of"]) & (placed["shard"] == dealt["of_shard"]))
    n = F.greatest(blocks, F.lit(1))
    placed = placed.withColumn("passes", F.floor(F.col("quota") / n)).withColumn("rest", (F.col("quota") % n) * block_tokens)
    placed = placed.withColumn("from", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), n) * block_tokens)
    # The rest runs over [from, from + rest) of a shard laid out twice; a document stands at start and at start + shard_size.
    end, until = F.col("start") + F.col("size"), F.col("from") + F.col("rest")
    here = (F.greatest("start", "from"), F.least(end, until))
    again = (F.greatest(F.col("start"), F.lit(0)), F.least(end, until - F.col("shard_size")))
    some = lambda x: F.greatest(x[1] - x[0], F.lit(0))
    whole = F.when(some(here) > 0, here[0] - F.col("start")).otherwise(0)
    last = F.when(some(here) > 0, whole + some(here) + some(again)).otherwise(some(again))
    return placed.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + some(here) + some(again)).alias("taken"),
        "passes", F.least(whole, F.col("size")).alias("first"), last.alias("last"),
        *([F.col("row_key").alias(key_col)] if keys else []),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **plan) -> DataFrame:
    """`docs` as the plan takes them: whole texts once a pass, and the words of the rest.

    A text of which only some words are taken is those words, joined by spaces.
    Rows are written with a key of their own first, so rows with a null id and
    rows that repeat an id are each taken as the plan has them.
    """
    # The row travels as one column, so no name of its own can clash.
    keyed = stash(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("row")), "rows")
    source_col = plan.pop("source_col", "source")
    planned = keyed.select("row_key", *[F.col("row")[c].alias(a) for c, a in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    plan_ = mix_plan(planned, "id", "text", "source", key_col="row_key", **plan).where("taken > 0")
    plan_ = plan_.select(F.col("row_key").alias("of"), F.struct("size", "passes", "first", "last").alias("plan"))
    rows = keyed.join(plan_, F.col("row_key") == F.col("of")).select(F.col("row")[text_col].alias("text"), "row", "plan")
    at = lambda name: F.col("plan")[name]
    length = at("last") - at("first")
    whole = length >= at("size")
    kinds = F.concat(F.array_repeat(F.lit(False), (at("passes") + whole.cast("int")).cast("int")), F.array_repeat(F.lit(True), (~whole & (length > 0)).cast("int")))
    rows = rows.withColumn("in_part", F.explode(kinds))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    cut = lambda start, n: F.slice(words, start.cast("int") + 1, n.cast("int"))
    over = F.concat(cut(at("first"), at("size") - at("first")), cut(F.lit(0), at("last") - at("size")))
    part = F.array_join(F.when(at("last") <= at("size"), cut(at("first"), length)).otherwise(over), " ")
    text = F.when(F.col("in_part"), part).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
