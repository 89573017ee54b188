"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.llm.common import stash

CAPACITY = 4096
END_ID = 2
#: Documents are cut into pieces of at most this many ids, besides whole windows.
PIECE = 512
#: Bytes of text that give so many ids, about.
PIECE_BYTES = 1536
#: About how many pieces are packed together (a few windows more or less don't matter).
GROUP_PIECES = 1024
#: Units whose ids a worker remembers (about 50 bytes each), and how many are new to the tokenizer at once.
MOST_UNITS, NEW_UNITS = 1_000_000, 4096
#: Bytes of text that are tokenized at once; some twenty arrays of numbers are made of them.
STEP_BYTES = 1 << 19
#: Fixed value: how a tokenizer of English words cuts texts; what it matches, lower-cased, is tokenized by itself.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Words with one of these bytes stay whole: apostrophes, the bars of special tokens, control characters.
_WHOLE = np.zeros(256, bool)
_WHOLE[[0x27, 0x7C, 0x7F, *range(0x00, 0x09), *range(0x0E, 0x20)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(data: np.ndarray, found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of what WORD_SPLIT matches in words of ASCII and Latin-1 letters; other words stay whole."""
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind = _KIND[data]
    kind[lead] = kind[lead + 1] = _LETTER
    odd = _WHOLE[data] | ((data >= 0x80) & (kind != _LETTER))
    sums = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    whole = sums[found.ends] > sums[found.starts]
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # Inside of words only, and not of those that stay whole.
    inside = np.zeros(len(data) + 1, np.int8)
    inside[found.starts[~whole]] += 1
    inside[found.ends[~whole]] -= 1
    begins &= np.cumsum(inside[:-1], dtype=np.int8) > 0
    begins[found.starts] = True
    starts = np.flatnonzero(begins)
    return starts, np.minimum(np.append(starts[1:], len(data)), found.ends[np.searchsorted(found.starts, starts, side="right") - 1])


class WordTokenizer:
    """Ids of whole texts, from a tokenizer whose tokens don't cross white space.

    Its ids of a text are then those of its words one after another. A tokenizer
    that lower-cases and cuts words by WORD_SPLIT is asked for smaller units.
    Each distinct unit is tokenized once and remembered; when there are
    MOST_UNITS, only those of the texts at hand stay.
    """

    def __init__(self, path: str, most_units: int = MOST_UNITS):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most_units
        how = json.loads(self.model.to_str())
        steps = (how.get("normalizer") or {}).get("normalizers", [])
        cuts_ = (how.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.cuts_words = {"type": "Lowercase"} in steps and cuts_[0].get("pattern") == {"Regex": WORD_SPLIT} and cuts_[0].get("invert") is True
        self.known = np.zeros(0, np.uint64)  # ascending hashes
        self.at = np.zeros(0, np.int64)  # where each one's ids are
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of known units, one after another."""
        lengths, at = self.lengths[slots], self.at[slots]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(at - (ends - lengths), lengths) + np.arange(int(lengths.sum()))], ends

    def keep(self, hashes: np.ndarray) -> None:
        slots = np.flatnonzero(np.isin(self.known, hashes, assume_unique=True))
        self.ids, ends = self.of(slots)
        self.known, self.lengths = self.known[slots], self.lengths[slots]
        self.at = ends - self.lengths

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Take in the ids of new units; hashes ascend."""
        lengths, flat = [], [self.ids]
        for a in range(0, len(texts), NEW_UNITS):
            for e in self.model.encode_batch_fast(texts[a : a + NEW_UNITS], add_special_tokens=False):
                ids = e.ids
                lengths.append(len(ids))
                flat.append(np.array(ids, np.uint32))
        lengths = np.array(lengths, np.int64)
        at = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate(flat)
        place = np.searchsorted(self.known, hashes)
        self.known, self.at, self.lengths = np.insert(self.known, place, hashes), np.insert(self.at, place, at), np.insert(self.lengths, place, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) of the texts."""
        data, offsets = tokens.utf8(texts)
        found = tokens.words(data, offsets, fold=False)
        if not len(found.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = units(data, found) if self.cuts_words else (found.starts, found.ends)
        hashes, sample, inverse = np.unique(tokens.spans(data, starts, ends, fold=self.cuts_words), return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.known, assume_unique=True)
        if new.any():
            if len(self.known) + int(new.sum()) > self.most:
                self.keep(hashes)
            self.learn(hashes[new], [data[a:b].tobytes().decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())])
        ids, stops = self.of(np.searchsorted(self.known, hashes)[inverse])
        return ids, np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]


#: The tokenizers of this worker process, so that its next task finds the units known.
_TOKENIZERS: dict[str, WordTokenizer] = {}


_PIECES = "doc_row long, doc_id long, start long, length long, doc_tokens long, ids binary"
_PIECES_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_row", "doc_id", "start", "length", "doc_tokens")] + [("ids", pa.binary())])


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole windows first, then pieces of at most `piece`."""
    whole = n // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [(s, min(piece, n - s)) for s in range(whole, n, piece)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, piece: int) -> Iterator[pa.RecordBatch]:
    tokenizer = _TOKENIZERS.setdefault(path, None) or WordTokenizer(path)
    _TOKENIZERS[path] = tokenizer
    for batch in batches:
        texts = batch.column("text")
        for a, b in tokens.steps(texts, STEP_BYTES):
            flat, offsets = tokenizer.encode(texts.slice(a, b - a))
            at, spans = [], []
            for i in range(b - a):
                some = cuts(int(offsets[i + 1] - offsets[i]) + 1, capacity, piece)
                at += [i] * len(some)
                spans += some
            at, (start, length) = np.array(at), np.array(spans, np.int64).T
            # Every document's ids and its end id lie one after another.
            sizes = np.diff(offsets) + 1
            flat = np.insert(flat, offsets[1:], np.uint32(END_ID)).astype("<u4")
            ends = (np.concatenate([[0], np.cumsum(sizes)[:-1]])[at] + start + length) * 4  # pieces touch, so ends are enough
            ids = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])
            rows, docs = (batch.column(c).slice(a, b - a).take(pa.array(at)) for c in ("doc_row", "doc_id"))
            yield pa.RecordBatch.from_arrays([rows, docs, pa.array(start), pa.array(length), pa.array(sizes[at]), ids], schema=_PIECES_ARROW)


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """doc_row, doc_id, start, length, doc_tokens, ids (little-endian 32-bit) of each document's pieces, id 2 at its end.

    doc_row names the row of the document, so that rows that repeat an id can be
    told apart; (doc_row, start) is unique. The tokenizer's tokens must not cross
    white space. Null texts are empty: their one piece is the end id.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _pieces(b, path, capacity, piece), _PIECES)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size: Karmarkar-Karp differencing of k-way partitions.

    Every size starts as a partition with all its weight in one window. The two
    partitions with the greatest spread are merged, the heaviest windows of one
    with the lightest of the other, until one is left.
    """
    n = len(sizes)
    parent = np.arange(n)
    loads, members = {}, {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads[i], members[i] = np.array([s]), np.array([i])  # windows not listed are empty
        heap.append((-s if k > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        la, lb, ma, mb = loads.pop(a), loads.pop(b), members.pop(a), members.pop(b)
        both = len(la) + len(lb) - k  # windows that must take from each
        if both > 0:
            # Ascending loads: the lightest of b's go to the heaviest of a's, and so on.
            joined = la[:both] + lb[:both][::-1]
            parent[mb[:both][::-1]] = ma[:both]
            load, member = np.concatenate([joined, la[both:], lb[both:]]), np.concatenate([ma[:both], ma[both:], mb[both:]])
        else:
            load, member = np.concatenate([la, lb]), np.concatenate([ma, mb])
        order = np.argsort(load, kind="stable")
        load, member = load[order], member[order]
        loads[a], members[a] = load, member
        least = load[0] if len(load) == k else 0
        heapq.heappush(heap, (-int(load[-1] - least), a))
    root = parent.copy()
    while True:
        up = parent[root]
        if (up == root).all():
            break
        root = up
    return np.unique(root, return_inverse=True)[1] if n else root


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over capacity; windows are added until that holds."""
    k, step = max(1, -(-int(sizes.sum()) // capacity)), 1
    while True:
        at = differencing(sizes, k)
        over = int(np.bincount(at, sizes).max()) - capacity if len(sizes) else 0
        if over <= 0:
            return at
        k += step
        step += step // 4 + (over > capacity // 8)


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """One group: `table` by document and place, with sequence_id and offset."""
    doc, start, size = (table.column(c).to_numpy() for c in ("doc_row", "start", "length"))
    order = np.lexsort((start, doc))
    size = size[order]
    whole = size == capacity
    at = np.zeros(len(order), np.int64)
    at[~whole] = windows(size[~whole], capacity)
    first = int(at[~whole].max()) + 1 if (~whole).any() else 0
    at[whole] = first + np.arange(int(whole.sum()))
    turn = np.argsort(at, kind="stable")
    before = np.cumsum(size[turn]) - size[turn]
    new = np.concatenate([[True], at[turn][1:] != at[turn][:-1]])
    offset = np.empty(len(order), np.int64)
    offset[turn] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
    shard = int(table.column("shard")[0].as_py())
    return table.take(pa.array(order)).append_column("sequence_id", pa.array(shard * (1 << 20) + at)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int | None = None) -> DataFrame:
    """`pieces` (doc_row, start, length and more columns) with sequence_id and offset.

    Pieces are dealt to `groups` (without it: of GROUP_PIECES each, which are
    counted for that) by a hash of their document's row (whole windows by hash
    of their start too), so no document, id or source makes a large group. Each
    group is packed into near-equal windows; pieces of a window lie gapless from
    0. Other columns, such as ids, travel along. No rows give no rows.
    """
    if groups is None:
        pieces = stash(pieces, "pieces")
        groups = -(-pieces.count() // GROUP_PIECES)
    shard = F.pmod(F.xxhash64("doc_row", F.when(F.col("length") == capacity, F.col("start")).otherwise(-1)), F.lit(max(1, groups))).cast("long")
    dealt = pieces.withColumn("shard", shard)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(lambda table: _pack(table, capacity), schema).drop("shard")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_row, doc_id, start, length, doc_tokens, ids, sequence_id, offset of every piece of `docs`.

    The windows with their ids (little-endian 32-bit) as they lie in them. Rows
    that repeat an id are packed like others and have a doc_row of their own. A
    null id is kept. No rows give no rows.
    """
    # About as many groups as the pieces need, from the length of the texts: so the ids are shuffled, but never written before.
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()
    groups = (sizes["docs"] + sizes["n"] // PIECE_BYTES) // GROUP_PIECES + 1
    packed = pack(tokenized_pieces(docs, tokenizer, id_col, text_col), groups=groups)
    return packed.withColumnRenamed("doc_id", id_col)


def packed_digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of packed_documents with the CRC-32 of a piece's ids in their place."""
    packed = packed_documents(docs, tokenizer, id_col, text_col)
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "doc_row")
