"""Merkle manifest of a dataset: every row's authentication path, by fractal traversal of aligned blocks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, stash
from docloom.llm.ranks import placed

#: Nodes that become one node of the level above.
ARITY = 16
#: Levels below the root of an aligned block: 16 ** 3 leaves a block.
BLOCK_LEVELS = 3
#: Rows of a batch that leaves a task: each carries a whole path.
BATCH_ROWS = 1000

_PATH = "array<struct<before:binary,after:binary>>"
_OUT = "key long, leaf binary, subroot binary, root binary, proof binary, widths array<struct<before:int,after:int>>, folded binary"
_OUT_ARROW = pa.schema([("key", pa.int64())] + [(c, pa.binary()) for c in ("leaf", "subroot", "root", "proof")] + [("widths", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32())]))), ("folded", pa.binary())])


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def row_digest(values: list[Column]) -> Column:
    """SHA-256, as bytes, of the values one after another: `-` for null, else the UTF-8 byte count, `:` and the value as text."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(told, values)), 256))


def _parent(children: Column) -> Column:
    """The digest over the children's digests as hex text."""
    return F.unhex(F.sha2(F.concat_ws("", F.transform(children, _hex)), 256))


def _levels_of(total: Column) -> Column:
    """How often runs of ARITY must be joined until one node is left."""
    return sum((F.when(total > ARITY**k, 1).otherwise(0) for k in range(15)), F.lit(0)).cast("int")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Level by level from the leaves: (grp, top, position, node), above the leaves with their children in order.

    `nodes` has grp, top (levels of the group's tree), position and node. A level
    is one pre-shuffled gathering of at most ARITY nodes a run, whatever the size
    of its group, and is written. The last level that any group has ends the list.
    """
    found, level = [nodes], 0
    highest = nodes.agg(F.max("top")).first()[0] or 0
    while level < highest:
        below = found[-1].where(F.col("top") > level).select("grp", "top", F.expr(f"position div {ARITY}").alias("run"), F.struct("position", "node").alias("child"))
        runs = below.groupBy("grp", "top", "run").agg(F.sort_array(F.collect_list("child")).alias("found"))
        children = F.col("found.node")
        found.append(stash(runs.select("grp", "top", F.col("run").alias("position"), _parent(children).alias("node"), children.alias("children")), "level"))
        level += 1
    return found


def _paths(levels: list[DataFrame], upper: DataFrame, down_to: int = 0) -> DataFrame:
    """grp, position, path for the nodes of level `down_to`, or for the tops of lower trees: what stands beside them from there to the root.

    `upper` has grp and the path from the group's top on; paths are handed down a
    level at a time by a join on the run.
    """
    heads = lambda level: levels[level].where(F.col("top") == level).select("grp", "position")
    joined = lambda rows: rows.alias("r").join(upper.alias("u"), F.col("r.grp").eqNullSafe(F.col("u.grp"))).select("r.*", "u.path")
    last = len(levels) - 1
    found = joined(heads(last))
    for level in range(last, down_to, -1):
        runs = levels[level].select("grp", "position", "children").alias("l").join(found.alias("f"), F.col("l.grp").eqNullSafe(F.col("f.grp")) & (F.col("l.position") == F.col("f.position"))).select("l.*", "path")
        child = runs.select("grp", "position", "path", "children", F.posexplode("children").alias("i", "_"))
        side = lambda a, n: F.unhex(F.concat_ws("", F.transform(F.slice("children", a, n), lambda c: F.hex(c))))
        beside = F.struct(side(F.lit(1), F.col("i")).alias("before"), side(F.col("i") + 2, F.lit(ARITY)).alias("after"))
        found = child.select("grp", (F.col("position") * ARITY + F.col("i")).alias("position"), F.concat(F.array(beside), F.col("path")).alias("path"))
        found = found.unionByName(joined(heads(level - 1)))
    low = [joined(heads(level)) for level in range(min(down_to, last))]
    for rows in low:
        found = found.unionByName(rows)
    return found


class _Subtree:
    """One run of nodes: what stands before and after each, as hex and as bytes."""

    def __init__(self, start: int):
        self.start, self.nodes, self.rows = start, [], []

    def sides(self, i: int) -> tuple[bytes, bytes]:
        return b"".join(self.nodes[:i]), b"".join(self.nodes[i + 1 :])


def _fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        digest = sha256((before + digest + after).hex().encode()).digest()
    return digest


def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Authentication paths of one leaf after another, in rows sorted as `proofs` sorts them.

    Of each level of a block two subtrees are held: the existing one, over the
    leaf whose path is due, and the desired one, that gathers the nodes of the run
    after it. A desired subtree takes the place of the existing one when its first
    leaf comes up. So a task holds 2 * ARITY nodes a level and one upper path,
    however many leaves there are.
    """
    block, upper, subroot, root = None, [], None, None
    existing: dict[int, _Subtree] = {}
    desired: dict[int, _Subtree] = {}
    out: list[tuple] = []

    def due(level: int) -> None:
        """The desired subtree of `level` is whole: it becomes the existing one; leaves give their paths."""
        tree = existing[level] = desired.pop(level)
        if level:
            return
        above = []
        for up in range(1, 1 + max(existing)):
            if up in existing:
                above.append(existing[up].sides((tree.start // ARITY**up) % ARITY))
        above += upper
        rest = b"".join(a + b for a, b in above)
        rest_widths = [{"before": len(a) // 32, "after": len(b) // 32} for a, b in above]
        for i, (key, leaf, changed) in enumerate(tree.rows):
            before, after = tree.sides(i)
            path = ([(before, after)] if alone is False else []) + above
            own = [{"before": len(before) // 32, "after": len(after) // 32}] if alone is False else []
            out.append((key, leaf, subroot, root, (before + after if own else b"") + rest, own + rest_widths, _fold(changed or leaf, path)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT_ARROW)], schema=_OUT_ARROW)

    alone = False
    for batch in batches:
        for grp, number, start, level, node, key, changed, path, top, sub, whole in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "start", "level", "node", "key", "changed", "path", "top", "subroot", "root"))):
            # A row of another run than the one that a desired subtree gathers: that one is whole.
            for at in sorted(desired, reverse=True):
                if (grp, number) != block or desired[at].start != start or at != level:
                    due(at)
            if (grp, number) != block:
                block, existing, desired = (grp, number), {}, {}
            if path is not None:
                upper, subroot, root, alone = [(p["before"], p["after"]) for p in path], sub, whole, top == 0
                continue
            tree = desired.setdefault(level, _Subtree(start))
            tree.nodes.append(node)
            if level == 0:
                tree.rows.append((key, node, changed))
            if len(out) >= BATCH_ROWS:
                yield batch_of(out)
                out = []
    for at in sorted(desired, reverse=True):
        due(at)
    for i in range(0, len(out), BATCH_ROWS):
        yield batch_of(out[i : i + BATCH_ROWS])


def proofs(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The authentication path of every leaf, in one tree a group under one root.

    `leaves` has grp (string), key (long), leaf (32 bytes) and changed (32 bytes or
    null). In a group, leaves ascend by key (null first), then leaf; while more than
    one node is left, ARITY consecutive ones (the last run may have fewer) become
    their parent: SHA-256 over their digests as hex text. The last node of a group
    is its subroot; subroots by group (null first, by UTF-8 bytes) become the root
    in the same way. Per leaf: key, leaf, subroot, root, proof (the 32-byte digests
    beside it, level by level, left to right), widths (how many stand before and
    after it on each level) and folded, the root recomputed from `changed`, where
    there is one, else from the leaf, and the proof. Repeated rows have a leaf
    each. No rows give no rows.

    Blocks of ARITY ** block_levels leaves are traversed in the tasks; the paths
    above them come with one row a block.
    """
    size = ARITY**block_levels
    rows = placed(leaves.select("grp", "key", "leaf", "changed"), ["grp"], [F.col("key"), F.col("leaf"), F.col("changed")])
    rows = stash(rows.withColumn("top", _levels_of(F.col("total"))).drop("total"), "leaves")
    levels = _levels(rows.select("grp", "top", "position", F.col("leaf").alias("node")))
    # The tree over the groups: their subroots are its leaves.
    subroots = levels[0].where("top = 0").select("grp", "node")
    for level in range(1, len(levels)):
        subroots = subroots.unionByName(levels[level].where(F.col("top") == level).select("grp", "node"))
    subroots = placed(subroots.withColumn("_all", F.lit("")), ["_all"], [F.col("grp")])
    subroots = stash(subroots.withColumn("top", _levels_of(F.col("total"))).drop("total"), "subroots")
    over = _levels(subroots.select(F.col("_all").alias("grp"), "top", "position", "node"))
    root = over[-1].where(F.col("top") == len(over) - 1).select(F.hex("node")).first()
    root = F.unhex(F.lit(root[0] if root else ""))
    empty = rows.sparkSession.range(1).select(F.lit("").alias("grp"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    of_groups = _paths(over, empty).select("position", "path").join(subroots.select("position", "grp", F.col("node").alias("subroot")), "position").drop("position")
    of_groups = stash(of_groups.withColumn("root", root), "groups")

    # Per block: the path from its top on, then level by level the runs that its leaves need, each before the leaves below it.
    shape = {"node": "binary", "key": "long", "changed": "binary", "path": _PATH, "top": "int", "subroot": "binary", "root": "binary"}
    columns = ["grp", "block", "start", "level", "place", *shape]
    filled = lambda df: df.select(*[c if c in df.columns else F.lit(None).cast(shape[c]).alias(c) for c in columns])
    heads = _paths(levels, of_groups.select("grp", "path"), block_levels)
    heads = heads.alias("h").join(of_groups.drop("path").alias("g"), F.col("h.grp").eqNullSafe(F.col("g.grp"))).select("h.*", "subroot", "root")
    tops = rows.where(F.col("position") % size == 0).select("grp", "position", "top")
    # A block's head has its number: that of its node on level block_levels, or 0 in a lower tree.
    heads = heads.withColumn("block", F.col("position")).alias("h").join(tops.withColumn("block", F.expr(f"position div {size}")).alias("t"), F.col("h.grp").eqNullSafe(F.col("t.grp")) & (F.col("h.block") == F.col("t.block"))).select("h.*", "t.top")
    parts = [filled(heads.withColumns({"start": F.col("block") * size, "level": F.lit(99), "place": F.lit(0).cast("long")}))]
    for level in range(min(block_levels, len(levels))):
        source = rows.withColumn("node", F.col("leaf")) if level == 0 else levels[level].where(F.col("top") > level)
        run = ARITY ** (level + 1)
        source = source.withColumns({"block": F.expr(f"position div {ARITY ** (block_levels - level)}"), "start": F.expr(f"position div {ARITY} * {run}"), "level": F.lit(level), "place": F.col("position")})
        source = source.drop("top")
        parts.append(filled(source))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.repartition("grp", "block").sortWithinPartitions("grp", "block", "start", F.desc("level"), "place").mapInArrow(traverse, _OUT)


def manifest(docs: DataFrame, values: list[str], id_col: str = "doc_id", group_col: str = "source", changed: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """`proofs` over the rows of a table: a leaf is the digest of `values`, a tree is a group.

    `changed` is the digest of what a row was made into, null where it was not
    touched; `folded` then shows what a check against the manifest finds. Nulls in
    any column have a digest of their own; other columns play no part.
    """
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("key"), row_digest([F.col(c) for c in values]).alias("leaf"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    return proofs(stash(leaves, "leaf"), block_levels).withColumnRenamed("key", id_col)


def tamper_test(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest of `documents`, checked after A-Z of every text whose id's CRC-32 is divisible by 5 went to lower case.

    doc_id, leaf, subroot, root, proof_sha256 (of the proof as hex text),
    folded_root and verified, digests as lower-case hex. A row without an id is
    not tampered with.
    """
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = row_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in values])
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    out = manifest(docs, values, changed=touched, block_levels=block_levels)
    return out.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"), _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
