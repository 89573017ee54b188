"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of word shingles. In any one order of all shingles, two sets
that are alike enough share a shingle among the first few of each (their
prefixes). Candidates share one under the first order, and are dropped unless
they share one under every other order too; only what passes all filters is
verified. All orders put rare shingles first, and differ in how they break ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import packed, tokens
from docloom.llm.common import dropped, gathered, partitions, sent, stash
from docloom.llm.components import components

SHINGLE = 5
PERCENT = 80
#: How many global orders the filter uses.
ORDERS = 3
#: Text bytes of a chunk of documents.
CHUNK_BYTES = 8 << 20
#: One document of each group meets the rest, again and again, until pairs of what is left are at most so many a row,
#: or a round leaves more than this share of them.
PAIRS_A_ROW, LEFT_A_ROUND = 4, 0.9
#: Shingles of pairs that are compared at once.
VERIFY_NUMBERS = 1 << 19

_SETS = "key long, id long, n long, shared long, digest binary, tokens binary, counts binary"
_SETS_ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("counts", pa.binary())])
_FIRSTS = "key long, n long, shared long, rank long, tokens binary, prefixes array<binary>"
_FIRSTS_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("rank", pa.int64()), ("tokens", pa.binary()), ("prefixes", pa.list_(pa.binary()))])


def _emit(batches: Iterator[pa.RecordBatch], parts: int, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of documents as packed shingles; the table has key, id, whether there is an id, and set size."""

    def close(held):
        sizes = [len(h[0]) for h in held]
        base = np.cumsum([0, *sizes])[:-1]
        keys, ids, known = (np.concatenate([h[k] for h in held]) for k in range(3))
        hashes = np.concatenate([h[3] for h in held])
        owner = np.concatenate([h[4] + b for h, b in zip(held, base)])
        counts = np.bincount(owner, minlength=len(keys)).astype(np.int64)
        return packed.deal(int(keys[0]), hashes, owner, packed.blob(keys, ids, known, counts), parts, wide=True)

    held, docs, total = [], 0, 0
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("key").to_numpy()
        ids, known = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        for a, b in tokens.steps(texts):
            for a, b in ((i, min(b, i + packed.MOST_DOCS)) for i in range(a, b, packed.MOST_DOCS)):
                if held and (docs + b - a > packed.MOST_DOCS or total > CHUNK_BYTES):
                    yield close(held)
                    held, docs, total = [], 0, 0
                data, offsets = tokens.utf8(texts.slice(a, b - a))
                hashes, owner = tokens.distinct(*tokens.shingles(tokens.words(data, offsets), size))
                held.append((keys[a:b], ids[a:b], known[a:b], hashes, owner))
                docs, total = docs + b - a, total + len(data)
    if held:
        yield close(held)


def _with_shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each document with its size; those that can have a partner with their shared shingles and counts too.

    Only shared shingles count in an intersection: with too few, there is no partner.
    """
    for _, table, who, names, counts in packed.gathered(batches, wide=True):
        keys, ids, known, sizes = packed.unblob(table, np.int64, np.int64, np.bool_, np.int64)
        order = np.lexsort((names, who))
        names, counts = names[order], counts[order]
        first = np.searchsorted(who, np.arange(len(keys) + 1))
        mix3, mix4 = tokens.mix(names, 3), tokens.mix(names, 4)
        out: list[tuple] = []
        for i, n in enumerate(sizes.tolist()):
            mine = slice(first[i], first[i + 1])
            shared = mine.stop - mine.start
            if n == 0 or 100 * shared < percent * n:
                out.append((shared, None, None, None))
                continue
            digest = np.bitwise_xor.reduce(mix3[mine]).tobytes() + np.add.reduce(mix4[mine]).tobytes() if shared == n else None
            out.append((shared, digest, names[mine].tobytes(), counts[mine].tobytes()))
        columns = [keys, pa.array(ids, mask=~known), sizes, *([o[k] for o in out] for k in range(4))]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SETS_ARROW)], schema=_SETS_ARROW)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, id, n, shared for every row; tokens, counts and digest where a partner is possible.

    key names the row within this table. shared is how many of its n shingles
    other rows have too; counts is how many rows have each. digest is given for
    sets of which every shingle is shared; equal sets have equal digests.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = packed.parts_for(partitions(docs.sparkSession), total)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = packed.by_part(rows.mapInArrow(lambda b: _emit(b, parts, size), packed.SCHEMA), parts)
    back = dealt.mapInArrow(lambda b: packed.shared(b, wide=True), packed.SCHEMA).repartition(parts, "chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(lambda b: _with_shared(b, percent), _SETS)


def _with_prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of one row of each set (`copies` rows have it): its prefixes under every order, if it can have a partner.

    A shingle that only copies of the set have is as good as unshared. Unshared
    ones come first in every order; where they fill the prefix, there is no
    partner. Then come the rarest; the orders differ where counts are equal.
    """
    for batch in batches:
        out = []
        for key, n, copies, names, counts in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "copies", "tokens", "counts"))):
            mine, often = np.frombuffer(names, np.uint64), np.frombuffer(counts, np.uint16).astype(np.int64)
            if 1 < copies < packed.MOST_SHARED:
                mine, often = mine[often != copies], often[often != copies]
            left = len(mine) - -(-percent * n // 100) + 1  # shared shingles in the prefix
            if left > 0:
                orders = (np.lexsort((tokens.mix(mine, 20 + k), often))[:left] for k in range(ORDERS))
                out.append((key, n, len(mine), n - len(mine), mine.tobytes(), [mine[o].tobytes() for o in orders]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIRSTS_ARROW)], schema=_FIRSTS_ARROW)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the first prefix; rest is how many shared shingles of the set stand there and after it."""
    for batch in batches:
        firsts = [np.frombuffer(p[0], np.int64) for p in batch.column("prefixes").to_pylist()]
        lengths = np.array([len(f) for f in firsts], np.int64)
        if len(firsts):
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key, n, shared, rank = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("key", "n", "shared", "rank"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(firsts), key, n, shared - place, rank)], names=["token", "key", "n", "rest", "rank"])


def _can_link(n: str, m: str, rest: str, other: str, percent: int) -> str:
    """SQL: whether sets of n and m shingles can be alike enough if the first one they share has so many shared ones from there on.

    What they share stands from their first common shingle on, in either set.
    Where this shingle is not the first that both have, the pair may fail here,
    but not at the first one.
    """
    most = f"least({rest}, {other})"
    return f"100 * {most} >= {percent} * ({n} + {m} - {most})"


def _flat(arrays: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a binary array's packed numbers."""
    offsets = np.frombuffer(arrays.buffers()[1], np.int32)[arrays.offset : arrays.offset + len(arrays) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = arrays.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, np.diff(offsets) // size


def shared_numbers(left: pa.Array, right: pa.Array, kind: type) -> np.ndarray:
    """For each pair of packed sets how many numbers both have."""
    out = np.zeros(len(left), np.int64)
    sizes = np.cumsum(pc.add(pc.binary_length(left), pc.binary_length(right)).to_numpy().astype(np.int64)) // np.dtype(kind).itemsize
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + VERIFY_NUMBERS, side="right")))
        stop = min(stop, at + packed.MOST_DOCS)
        (a, n), (b, m) = (_flat(x.slice(at, stop - at), kind) for x in (left, right))
        who = np.concatenate([np.repeat(np.arange(stop - at), n), np.repeat(np.arange(stop - at), m)]).astype(np.uint16)
        order = np.argsort(values := np.concatenate([a, b]))
        order = order[np.argsort(who[order], kind="stable")]
        values, who = values[order], who[order]
        out[at:stop] = np.bincount(who[1:][(values[1:] == values[:-1]) & (who[1:] == who[:-1])], minlength=stop - at)
        at = stop
    return out


def _verify(batches: Iterator[pa.RecordBatch], percent: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The pairs that share a prefix shingle under every order and are alike enough."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n", "n_b"))
        batch = batch.filter(pa.array(100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
        for k in range(len(batch.column("prefixes")[0]) if batch.num_rows else 0):
            one, other = (pc.list_element(batch.column(c), k) for c in ("prefixes", "prefixes_b"))
            batch = batch.filter(pa.array(shared_numbers(one, other, np.int64) > 0))
        n, m = (batch.column(c).to_numpy() for c in ("n", "n_b"))
        both = shared_numbers(batch.column("tokens"), batch.column("tokens_b"), kind)
        yield batch.select(["u", "v"]).filter(pa.array(100 * both >= percent * (n + m - both)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, kind: type = np.int64, little: int = 0) -> DataFrame:
    """The pairs (u, v: keys of `sets`) that pass every order's filter and the exact test; tokens are of the given kind.

    The filter of the first order is what made the pairs, so its prefixes stay behind. Sets in no pair are left out
    before the pairs meet them.
    """
    asked = gathered(pairs, little).select(F.explode(F.array("u", "v")).alias("asked")).distinct()
    some = sets.join(sent(asked, little // 8, pairs), sets["key"] == F.col("asked"), "left_semi")
    some = stash(some.select("key", "n", "tokens", F.slice("prefixes", 2, 1_000).alias("prefixes")), "asked")
    other = some.select(*[F.col(c).alias(c if c == "key" else f"{c}_b") for c in some.columns])
    both = other.join(sent(pairs, little // 8), F.col("key") == F.col("v")).drop("key")
    both = both.join(sent(some, little // 8), both["u"] == some["key"]).drop("key")
    found = stash(both.mapInArrow(lambda b: _verify(b, percent, kind), "u long, v long"), "near")
    dropped(some)
    return found


def near_links(sets: DataFrame, percent: int = PERCENT, kind: type = np.int64, little: int = 0) -> DataFrame:
    """Links (u, v) of representatives in `sets`, enough to join all that hang together.

    Documents that share a prefix shingle form a group. In each round the
    document of least rank of a group meets the others: in a group of near
    copies, that is one without edits of its own, to which most others link. What
    is then in the same component needs no further test, a document that can link
    with none of another component leaves the group, and a group of one component
    is done. Rounds go on as long as they make pairs fewer and these are many
    more than the rows; the rest then meets pairwise. Both kinds of pairs need
    enough shared shingles from the one where they meet onwards. So no link
    between components is lost, and a group of near copies costs its size, not
    its square. Tables of up to `little` bytes are taken by one task.
    """
    columns = ("token", "key", "n", "rest", "rank")
    places = sets.select("key", "n", "shared", "rank", "prefixes").mapInArrow(_explode, ", ".join(f"{c} long" for c in columns))
    places = stash(places, "places")
    groups = places.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    table = stash(places.join(groups, "token").withColumn("component", F.col("key")), "places")
    links, before = None, None
    while True:
        places = gathered(table, little)
        leads = places.groupBy("token").agg(F.min(F.struct("rank", "key", "n", "rest", "component")).alias("lead"))
        leads = leads.select("token", *[F.col("lead")[c].alias(a) for c, a in (("key", "u"), ("n", "m"), ("rest", "other"), ("component", "component_u"))])
        met = places.join(leads, "token").where("key != u").withColumn("meets", F.expr(f"component != component_u and {_can_link('n', 'm', 'rest', 'other', percent)}"))
        met = stash(met.select(*columns, "component", "u", "meets"), "met")
        pairs = stash(gathered(met, little).where("meets").select("u", F.col("key").alias("v")).distinct(), "pairs")
        found = verified(pairs, sets, percent, kind, little)
        # What hangs together so far goes on as stars, which settle fast.
        labels = stash(components(found if links is None else links.unionByName(found), little=little), "labels")
        links = labels.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        # A leader has met its whole group; what is left there must still span two components.
        left = gathered(met, little).select(*columns).join(gathered(labels, little), F.col("key") == F.col("node"), "left").select(*columns, F.coalesce("component", "key").alias("component"))
        left = stash(left.withColumn("most", F.expr(f"(100 + {percent}) * rest - {percent} * n")), "left")
        # Of any two that can link, `most` of each is at least percent * n of the other.
        each = gathered(left, little).groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.max("most").alias("most"), F.min("n").alias("n"))
        open_ = each.groupBy("token").agg(F.max("most").alias("most_of"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("parts"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs"))
        open_ = stash(open_.where("parts > 1"), "open")
        able = gathered(left, little).join(gathered(open_, little), "token").where(f"most_of >= {percent} * n and most >= {percent} * least_n")
        old, table = table, stash(able.select(*columns, "component"), "places")
        rows, still = table.count(), open_.agg(F.sum("pairs")).first()[0] or 0
        dropped(old, met, pairs, found, left, open_)
        if not rows or not still:
            return links
        if still <= PAIRS_A_ROW * rows or (before and still > LEFT_A_ROUND * before):
            break
        before = still
    places = gathered(table, little)
    other = places.select("token", F.col("key").alias("v"), F.col("n").alias("m"), F.col("rest").alias("other"), F.col("component").alias("component_v"))
    pairs = places.join(other, "token").where("key < v and component != component_v").where(_can_link("n", "m", "rest", "other", percent))
    pairs = stash(pairs.select(F.col("key").alias("u"), "v").distinct(), "pairs")
    return links.unionByName(verified(pairs, sets, percent, kind, little))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id for every row of `docs`.

    Words are runs of characters other than white space, A-Z lower-cased. A set
    has the distinct shingles of `size` words; a text with fewer words is one
    shingle, one without (or null) has none and is linked with nothing. Two rows
    link when 100 * intersection >= percent * union. component_id is the smallest
    id that links reach. Rows that repeat an id are rows of their own; a null id
    is larger than any other and names a component only if all its ids are null.
    Shingles are compared by hash. No rows give no rows.
    """
    sets = stash(shingle_sets(docs, id_col, text_col, size, percent), "sets")
    able = sets.where("tokens is not null")
    # Rows with equal sets are one from here on: the one with the least key.
    classes = able.where("digest is not null").groupBy("digest", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    members = stash(able.select("key", "n", "digest").join(classes, ["digest", "n"]).select(F.col("key").alias("member"), "first", "copies"), "members")
    copies = members.where("member != first").select(F.col("first").alias("u"), F.col("member").alias("v"))
    firsts = able.join(members, able["key"] == members["member"], "left").where("member is null or member = first")
    firsts = firsts.select("key", "n", F.coalesce("copies", F.lit(1)).alias("copies"), "tokens", "counts")
    firsts = stash(firsts.mapInArrow(lambda b: _with_prefixes(b, percent), _FIRSTS), "firsts")
    links = stash(near_links(firsts, percent), "near")
    # Copies join their first last, so that the steps of components don't carry them.
    near = components(links)
    of_copy = copies.join(near, copies["u"] == near["node"], "left").select(F.col("v").alias("node"), F.coalesce("component", "u").alias("component"))
    of_first = copies.select("u").distinct().join(near, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    labels = stash(near.unionByName(of_copy).unionByName(of_first), "labels")
    rows = sets.select("key", "id", "n")
    named = stash(rows.join(labels, rows["key"] == labels["node"]).select("id", "n", "component"), "named")
    least = stash(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    linked = named.join(least, "component").select("id", "n", "component_id")
    alone = rows.join(labels, rows["key"] == labels["node"], "left_anti").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each component: the one whose id names it. Rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **how)
    gone = stash(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
