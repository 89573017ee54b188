"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered, so that equal numbers mean equal blocks; then adjacent
numbers are paired, the distinct pairs are sorted and numbered again, and so on
until every document is left with one number. Equal (round, number) means equal
text: nothing rests on a digest being free of collisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, stash


def _numbered(keys: DataFrame, *by: str) -> DataFrame:
    """Integer names in sort order. Written at once: a name never changes afterwards."""
    return stash(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _block(i):
    return lambda size: F.substring(F.col("bytes"), i * size + 1, F.lit(size))


def block_identity(texts: DataFrame, keys: list[str], block_bytes: int = 4096) -> DataFrame:
    """`keys`, `level`, `name` for each row of `texts` (`keys`, `bytes` binary, not null).

    Equal (level, name) if and only if equal bytes. Keys must be unique.

    Blocks sort by (64-bit hash, content). Where one hash has one content, which
    the aggregation proves by comparing its least and greatest block, the hash
    alone finds the name and the content need not move again; blocks whose hash
    has several contents are found by content.
    """
    last = F.greatest(F.ceil(F.octet_length("bytes") / F.lit(block_bytes)) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: _block(i)(block_bytes))
    blocks = texts.select(F.explode(cut).alias("block")).withColumn("hash", F.xxhash64("block"))
    found = stash(blocks.groupBy("hash").agg((F.min("block") != F.max("block")).alias("several")), "blocks")
    plain = found.where(~F.col("several")).select("hash", F.lit(None).cast("binary").alias("block"))
    several = found.where("several").select("hash")
    shared = not several.isEmpty()
    if shared:
        plain = plain.unionByName(blocks.join(several, "hash", "left_semi").select("hash", "block").distinct())
    names = _numbered(plain, "hash", "block")

    places = texts.select(*keys, (last + 1).alias("left"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(_block(i)(block_bytes)))).alias("pos", "hash"))
    named = places.join(names.where("block is null").select("hash", "name"), "hash")
    if shared:
        places = texts.select(*keys, (last + 1).alias("left"), F.posexplode(cut).alias("pos", "block")).withColumn("hash", F.xxhash64("block"))
        named = named.unionByName(places.join(names.where("block is not null"), ["hash", "block"]).drop("block"))
    current, level, done = stash(named.select(*keys, "left", "pos", "name"), "level"), 0, []
    while True:
        done.append(current.where("left = 1").select(*keys, F.lit(level).alias("level"), "name"))
        rest = current.where("left > 1")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        even = F.col("pos") % 2 == 0
        pairs = stash(
            rest.groupBy(*keys, F.ceil(F.col("left") / 2).cast("int").alias("half"), F.floor(F.col("pos") / 2).cast("int").alias("at"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")),
            "pairs",
        )
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        current = stash(pairs.join(names, ["a", "b"]).select(*keys, F.col("half").alias("left"), F.col("at").alias("pos"), "name"), "level")
        level += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id of a group stays. Rows that repeat id and text
    all count in group_size and are all returned, one of them kept. A null id is
    less than any other; if a group has no other, keep_id is null and one row
    stays. No rows give no rows; other columns are not read.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
    # An id that comes with several texts is told apart by the digest.
    keyed = rows.select("id", F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("no_id"), "sha", F.col("norm").cast("binary").alias("bytes"))
    identity = block_identity(keyed, ["k", "no_id", "sha"], block_bytes).distinct()
    counts = keyed.groupBy("id", "k", "no_id", "sha").agg(F.count(F.lit(1)).alias("rows"))
    members = stash(counts.join(identity, ["k", "no_id", "sha"]), "members")
    groups = stash(members.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    # What is alone in its group needs no join: the hot groups are what AQE splits.
    return (
        members.join(groups, ["level", "name"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each text: of the rows that exact_dedup calls kept.

    Of rows that repeat both id and text (A-Z folded) one stays, the least text of
    them. A row with a null id goes if a row with an id has its text.
    """
    found = exact_dedup(docs, id_col, text_col).groupBy(F.col(id_col).alias("of_id"), F.col("text_sha256").alias("of_sha"))
    found = stash(found.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "gone")
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    same = docs[id_col].eqNullSafe(found["of_id"]) & (sha == found["of_sha"])
    left = docs.join(found, same, "left_anti")
    repeated = found.where("stays")
    if repeated.isEmpty():
        return left
    # The row travels as one column, so no name of its own can clash.
    rows = docs.select(F.col(id_col).alias("of"), sha.alias("sha"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(repeated, rows["of"].eqNullSafe(repeated["of_id"]) & (rows["sha"] == repeated["of_sha"]), "left_semi")
    one = rows.groupBy("of", "sha").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return left.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
