"""A corpus-wide count of 64-bit tokens, shuffled in packed arrays.

Documents are taken in chunks; of a chunk, each of P parts gets one row with its
share of the tokens: a 16-bit number of the document and 32 bits of the token a
piece, or 48 bits where `wide`. A part sees every token that falls to it, counts
the documents that have it, and sends those that at least two have back to their
chunks. Tokens that share those bits within a part count together, so counts may
come out too high, seldom and everywhere alike; a user must not rely on a count
being small. Parts are as many as the bytes of the texts ask for (`parts_for`),
and a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows between the steps. chunk: names the chunk. part: goes by it. table: whether blob is the chunk's table of documents.
SCHEMA = "chunk long, part int, is_table boolean, blob binary"
ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("is_table", pa.bool_()), ("blob", pa.binary())])
MOST_DOCS = 1 << 16
#: Counts end here: a token so frequent may be more frequent.
MOST_SHARED = (1 << 16) - 1
#: Text bytes whose tokens one part holds, about.
PART_BYTES = 32 << 20


def blob(*arrays: np.ndarray) -> bytes:
    """The number of entries and the arrays, one after another."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unblob(data, *types) -> list[np.ndarray]:
    data = memoryview(data)
    n, at, out = int(np.frombuffer(data[:8], np.int64)[0]), 8, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(data[at : at + size], t))
        at += size
    return out


def rows(chunks: list[int], parts: list[int], tables: list[bool], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(parts, pa.int32()), pa.array(tables, pa.bool_()), pa.array(blobs, pa.binary())], schema=ARROW)


def parts_for(partitions: int, text_bytes: int) -> int:
    return max(partitions, text_bytes // PART_BYTES + 1)


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def deal(chunk: int, tokens: np.ndarray, owner: np.ndarray, table: bytes, parts: int, wide: bool = False) -> pa.RecordBatch:
    """One chunk's rows: its table, and its tokens by part; owner numbers its documents, below MOST_DOCS."""
    if len(owner) and owner.max() >= MOST_DOCS:
        raise ValueError(f"a chunk has more than {MOST_DOCS} documents")
    part = part_of(tokens, parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    ranked, who = tokens[order], owner[order].astype(np.uint16)
    bits = [ranked.astype(np.uint32)]
    if wide:
        bits.append(((ranked >> np.uint64(32)) // np.uint64(parts)).astype(np.uint16))
    ends = np.cumsum(np.bincount(part, minlength=parts))
    starts = np.concatenate([[0], ends[:-1]])
    used = np.flatnonzero(ends > starts)
    blobs = [blob(who[starts[p] : ends[p]], *(b[starts[p] : ends[p]] for b in bits)) for p in used]
    return rows([chunk] * (len(used) + 1), [*used.tolist(), chunk % parts], [False] * len(used) + [True], [*blobs, table])


def by_part(dealt: DataFrame, parts: int) -> DataFrame:
    """Dealt rows, each part in a partition of its own."""
    return dealt.repartitionById(parts, "part")


def shared(batches: Iterator[pa.RecordBatch], wide: bool = False) -> Iterator[pa.RecordBatch]:
    """Of one part's rows: the tokens that several documents have, with their count (MOST_SHARED at most)."""
    bits = [np.uint32, np.uint16] if wide else [np.uint32]

    def close(part: int, pieces: list) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([p[2] for p in pieces])
        if wide:
            low = low | (np.concatenate([p[3] for p in pieces]).astype(np.uint64) << np.uint64(32))
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        new = np.ones(len(low), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        counts = np.bincount(group)
        count = np.empty(len(low), np.int64)
        count[order] = counts[group]
        at = 0
        for chunk, who, *mine in pieces:
            here = count[at : at + len(who)]
            at += len(who)
            keep = here > 1
            if keep.any():
                yield rows([chunk], [part], [False], [blob(who[keep], *(b[keep] for b in mine), np.minimum(here[keep], MOST_SHARED).astype(np.uint16))])

    current, pieces = None, []
    for batch in batches:
        for chunk, part, is_table, data in zip(*(batch.column(c) for c in ("chunk", "part", "is_table", "blob"))):
            chunk, part = chunk.as_py(), part.as_py()
            if part != current:
                if pieces:
                    yield from close(current, pieces)
                current, pieces = part, []
            if is_table.as_py():
                yield rows([chunk], [part], [True], [data.as_py()])
            else:
                pieces.append((chunk, *unblob(data.as_buffer(), np.uint16, *bits)))
    if pieces:
        yield from close(current, pieces)


def gathered(batches: Iterator[pa.RecordBatch], wide: bool = False) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows ordered by chunk: (chunk, table, owner, token names, counts), by owner.

    A token's name is its part and its bits in one 64-bit number.
    """
    bits, shift = ([np.uint32, np.uint16], 48) if wide else ([np.uint32], 32)

    def close(chunk, table, pieces):
        who, names, counts = (np.concatenate([np.zeros(0, t), *(p[k] for p in pieces)]) for k, t in enumerate((np.uint16, np.uint64, np.uint16)))
        order = np.argsort(who, kind="stable")
        return chunk, table, who[order], names[order], counts[order]

    current, table, pieces = None, None, []
    for batch in batches:
        for chunk, part, is_table, data in zip(*(batch.column(c) for c in ("chunk", "part", "is_table", "blob"))):
            if chunk.as_py() != current:
                if current is not None:
                    yield close(current, table, pieces)
                current, table, pieces = chunk.as_py(), None, []
            if is_table.as_py():
                table = data.as_py()
            else:
                who, low, *more, counts = unblob(data.as_buffer(), np.uint16, *bits, np.uint16)
                name = low.astype(np.uint64) | np.uint64((part.as_py() << shift) % (1 << 64))
                for b in more:
                    name |= b.astype(np.uint64) << np.uint64(32)
                pieces.append((who, name, counts))
    if current is not None:
        yield close(current, table, pieces)
