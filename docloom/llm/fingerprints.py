"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it
grows with its document: sketches of very unequal documents stay comparable, and
the sketch of a union is the union of sketches. Where no hash is that low, the
least one is kept, so only a text without words has an empty sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.llm.common import partitions

FRACTION = 1 / 8
SHINGLE = 5
_MAX = 1 << 64


class Sketches:
    """Sketches of several texts: hashes by text, ascending; first: where each text's begin."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        self.hashes, self.first, self.sizes = hashes, first, sizes

    def __len__(self) -> int:
        return len(self.first) - 1

    def one(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def strings(self) -> list[str]:
        """`number of shingles:base64 of the little-endian hashes`."""
        return [f"{n}:{base64.b64encode(self.one(i).astype('<u8').tobytes()).decode()}" for i, n in enumerate(self.sizes)]


def sketch(texts: pa.Array, fraction: float = FRACTION, size: int = SHINGLE) -> Sketches:
    data, offsets = tokens.utf8(texts)
    hashes, owner = tokens.distinct(*tokens.shingles(tokens.words(data, offsets), size))
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    least = np.ones(len(hashes), bool)
    least[1:] = owner[1:] != owner[:-1]
    low = hashes < np.uint64(min(_MAX - 1, int(fraction * _MAX)))
    keep = low | (least & ~low)  # a text's first hash is its least
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(texts)), out=first[1:])
    return Sketches(hashes[keep], first, sizes)


def parse(fingerprint: str) -> tuple[int, np.ndarray]:
    n, _, body = fingerprint.partition(":")
    return int(n), np.frombuffer(base64.b64decode(body), "<u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    low = both[both < np.uint64(min(_MAX - 1, int(fraction * _MAX)))]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's shingles that b has too, as estimated; 1 for an empty a."""
    return len(np.intersect1d(a, b, True)) / len(a) if len(a) else 1.0


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each i the Jaccard similarity of a's and b's sketch, and the containment of each in the other.

    Two empty sketches are alike (1); an empty and another one are not (0).
    """
    n_a, n_b = np.diff(a.first), np.diff(b.first)
    owner = np.concatenate([np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)])
    hashes = np.concatenate([a.hashes, b.hashes])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    twice = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    shared = np.bincount(owner[1:][twice], minlength=len(a)).astype(float)
    over = lambda n: np.where(n > 0, shared / np.maximum(n, 1), (n_a + n_b == 0).astype(float))
    return over(n_a + n_b - shared), over(n_a), over(n_b)


_LEAST = -(1 << 63)
_PLACED = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("key", pa.int64()), ("id", pa.int64()), ("text", pa.string())])
_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_in_edited", pa.float64()), ("kept_in_next", pa.float64())])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").cast(pa.int64()).fill_null(_LEAST).to_numpy(zero_copy_only=False)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, guest, key, id, text), dealt so that each part is a range of ids.

    In descending id, what follows a part's last row is its one guest: the first
    row of the next part that has any, or of all for the last part. Each text
    moves once. The driver holds two numbers a part, and parts are as many as
    shuffle partitions ask for. A null id comes last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * partitions(docs.sparkSession)
    cuts = sorted(set(rows.where("id is not null").approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    cuts = np.array(cuts, float).astype(np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            keys = _keys(batch)
            parts = np.searchsorted(cuts, keys)
            for p in np.unique(parts):
                best[int(p)] = max(best.get(int(p), _LEAST), int(keys[parts == p].max()))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(best), pa.int32()), "top": pa.array(list(best.values()), pa.int64())})

    found = rows.select("id").mapInArrow(tops, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).orderBy("part").collect()
    # Guests go one used part up; the largest of all goes to the lowest part.
    visits = {found[i].top: found[i + 1].part for i in range(len(found) - 1)} | ({found[-1].top: found[0].part} if found else {})
    tops_sorted = np.array(sorted(visits), np.int64)
    to_part = np.array([visits[t] for t in tops_sorted.tolist()], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(tops_sorted, keys), len(tops_sorted) - 1)
            visit = np.flatnonzero(tops_sorted[at] == keys)
            for take, parts, guest in ((np.arange(len(keys)), np.searchsorted(cuts, keys), False), (visit, to_part[at[visit]], True)):
                if len(take):
                    some = batch if not guest else batch.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.full(len(take), guest)), pa.array(keys[take]), some.column("id"), some.column("text")], schema=_PLACED)

    return rows.mapInArrow(place, "part int, guest boolean, key long, id long, text string")


def _compare(batches: Iterator[pa.RecordBatch], fraction: float) -> Iterator[pa.RecordBatch]:
    """Of rows by part, own before guests, descending key: each own row against the row after it."""

    def flush(rows: list[tuple], after: tuple | None) -> pa.RecordBatch:
        texts = [r[1] for r in rows] + [after[1]]
        halves = [len(t) // 2 for t in texts[:-1]]
        edited = [t[: len(t) - h] + nxt[:h] for t, h, nxt in zip(texts, halves, texts[1:])]
        every = sketch(pa.array(texts, pa.large_string()), fraction)
        m = len(rows)
        own = Sketches(every.hashes[: every.first[m]], every.first[: m + 1], every.sizes[:m])
        nexts = Sketches(every.hashes[every.first[1] :], every.first[1:] - every.first[1], every.sizes[1:])
        other = sketch(pa.array(edited, pa.large_string()), fraction)
        near_edited, kept_edited, _ = likeness(own, other)
        near_next, kept_next, _ = likeness(own, nexts)
        columns = [[r[0] for r in rows], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in edited], own.strings(), other.strings(), near_edited, near_next, kept_edited, kept_next]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    part, held, size, guest_seen = None, [], 0, False
    for batch in batches:
        for p, guest, i, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "id", "text"))):
            if p != part:
                part, held, size, guest_seen = p, [], 0, False
            if guest_seen:
                continue
            if held and (guest or size > tokens.STEP_BYTES):
                yield flush(held, (i, text))
                held, size = [], 0
            guest_seen = guest
            if not guest:
                held.append((i, text))
                size += len(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Every document's sketch, the sketch of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by descending id; the last
    document is followed by the first. near_edited and near_next are Jaccard
    similarities as the sketches give them; kept_in_edited and kept_in_next the
    containment of this document in the other. Null texts count as empty; an
    empty one has the fingerprint `0:`. Rows that repeat an id stand in the order
    of their texts. A single row follows itself. No rows give no rows.
    """
    placed = with_next(docs, id_col, text_col)
    dealt = placed.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", F.col("key").desc(), "text")
    out = dealt.mapInArrow(lambda batches: _compare(batches, fraction), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double, kept_in_next double")
    return out.withColumnRenamed("id", id_col)
