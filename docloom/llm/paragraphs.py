"""Substring dedup by paragraph MinHash banding.

A paragraph is a run of whole sentences, or of words where sentences are long or
have no marks. Paragraphs get MinHash signatures cut
into bands; those of different documents that agree on a band are candidates,
candidates are verified by the exact Jaccard similarity of their word shingles,
verified links are joined to components, and of a component the paragraphs of
its first document stay while those of the others are removed. Equal paragraphs
of one document are searched for once and removed at all their places.

Bands alone would gather all paragraphs that have a common line in them. So
colliding paragraphs meet by their rarest shingles: alike ones share one among
the rarest fifth of either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import packed, tokens
from docloom.llm.buckets import NO_ID, dealt, each_row, skipped, texts_of
from docloom.llm.common import LITTLE, dropped, stash
from docloom.llm.components import components
from docloom.llm.jaccard_join import near_links

SHINGLE = 5
PERCENT = 80
#: A paragraph takes sentences until it has so many words: shorter ones recur by chance.
MIN_WORDS = 20
#: In any so many words that hold the start of a sentence, a paragraph starts. Far from the next end of one, in any 2 * APART - 1 words.
APART = 8
#: A paragraph that meets no end of a sentence in so many words after its first MIN_WORDS ends with these.
SLACK = 16
#: Bands of rows. Paragraphs alike by 0.8 agree on a band with a chance of 1 - (1 - 0.8 ** 3) ** 8 = 0.997.
BANDS, ROWS = 8, 3
#: Text bytes that one step works on.
STEP_BYTES = 2 << 20
#: Frequent shingles whose number is told to all tasks, as 12 bytes each; the others count as rare. Any order gives the same links.
FREQUENT = 200_000
_MAX = np.uint64((1 << 64) - 1)
_PLACE = np.uint64((1 << 28) - 1)

_SETS = "key long, id long, chunk long, who int, spans binary, n long, rank long, digest binary, tokens binary, prefixes array<binary>"
_SETS_ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("chunk", pa.int64()), ("who", pa.int32()), ("spans", pa.binary()), ("n", pa.int64()), ("rank", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("prefixes", pa.list_(pa.binary()))])


# --- paragraphs and their signatures -----------------------------------------


class Paragraphs(NamedTuple):
    """owner: number of the text; start, stop: bytes in the data; first, last: range in shingles, the hashes at every word."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray
    shingles: np.ndarray


def _least_of_every(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if width < n else values


def paragraphs_of(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, apart: int = APART, size: int = SHINGLE) -> Paragraphs:
    """The paragraphs of texts: from a chosen word on, whole sentences until there are min_words words.

    Sentences end at a word with a final `.`, `!` or `?` and at line ends. Starts
    are chosen by the hash of the words there, so that equal passages get equal
    paragraphs wherever they stand: of the starts of sentences the least within
    every `apart` words; of the words whose sentence goes on for min_words words,
    the least within every 2 * apart - 1. If no sentence ends from min_words to
    before min_words + SLACK words after the start, the paragraph has min_words
    words. So any 2 * apart - 1 + min_words + SLACK words of which none ends a
    sentence have a paragraph that the words around them don't change.
    """
    found = tokens.words(data, offsets)
    n, counts = len(found.hashes), np.diff(found.first)
    none = np.zeros(0, np.int64)
    if not n or counts.max() < min_words:
        return Paragraphs(none, none, none, none, none, np.zeros(0, np.uint64))
    owner = np.repeat(np.arange(len(counts)), counts)
    left = found.first[1:][owner] - np.arange(n)
    shingles = np.zeros(n, np.uint64)
    shingles[(left >= size) | ((counts[owner] < size) & (left == counts[owner]))] = tokens.shingles(found, size)[0]
    lines = np.cumsum(data == 10)
    ends = np.isin(data[found.ends - 1], np.frombuffer(b".!?", np.uint8))
    ends[:-1] |= lines[found.starts[1:]] > lines[found.ends[:-1] - 1]
    begins = np.ones(n, bool)
    begins[1:] = ends[:-1]
    begins[found.first[:-1][found.first[:-1] < n]] = True
    places = np.flatnonzero(begins)
    stops = np.append(places, n)
    ahead = stops[np.searchsorted(stops, np.arange(n), side="right")] - np.arange(n)
    first = np.union1d(_chosen(places[left[places] >= min_words], owner, shingles, apart), _chosen(np.flatnonzero(ahead >= min_words), owner, shingles, 2 * apart - 1))
    if not len(first):
        return Paragraphs(none, none, none, none, none, shingles)
    stop = stops[np.searchsorted(stops, first + min_words)]
    stop = np.where(stop - first < min_words + SLACK, stop, first + min_words)
    return Paragraphs(owner[first], found.starts[first], found.ends[stop - 1], first, stop - size + 1, shingles)


def _chosen(starts: np.ndarray, owner: np.ndarray, shingles: np.ndarray, apart: int) -> np.ndarray:
    """Of `starts`, those with the least hash within some `apart` words, ascending."""
    if not len(starts):
        return starts
    line = np.full(len(shingles) + (int(owner[-1]) + 1) * apart, _MAX)  # words with a gap between texts
    line[starts + owner[starts] * apart] = (tokens.mix(shingles[starts], 41) & ~_PLACE) | np.arange(len(starts), dtype=np.uint64)
    chosen = np.unique(_least_of_every(np.concatenate([np.full(apart, _MAX), line]), apart))
    return starts[np.sort((chosen[chosen != _MAX] & _PLACE).astype(np.int64))]


def distinct_paragraphs(p: Paragraphs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, spans, edges): one of each equal paragraphs of a text; the (start, stop) of all their places, overlapping ones joined; those of number i lie between edges i and i + 1."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(p.shingles, k), dtype=np.uint64)]) for k in (5, 6)]
    keys = [p.owner, p.last - p.first, *(x[p.last] - x[p.first] for x in sums)]
    order = np.lexsort((p.start, *keys))
    new, start, stop = np.ones(len(order), bool), p.start[order], p.stop[order]
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    run = new.copy()
    run[1:] |= start[1:] > stop[:-1]
    at = np.flatnonzero(run)
    spans = np.stack([start[at], stop[np.append(at[1:], len(order))[: len(at)] - 1]], axis=1)
    return order[new], spans, np.append(np.flatnonzero(new[at]), len(at))


def signatures(shingles: np.ndarray, first: np.ndarray, last: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit name of each band of each paragraph, whose shingles are shingles[first:last] (never empty)."""
    order = np.argsort(first, kind="stable")  # in the order of the text, so that what lies between is not read
    edges = np.stack([first[order], last[order]], axis=1).reshape(-1)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        name = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            factor = int(tokens.mix(np.array([b * rows + r], np.uint64), 11)[0]) | 1
            values = np.append(shingles * np.uint64(factor) + np.uint64(factor >> 7), _MAX)
            name = tokens.mix(name ^ np.minimum.reduceat(values, edges)[::2], 12)
        out[order, b] = name
    return out


# --- the distributed part ----------------------------------------------------


def _steps(texts: list[bytes], skip: dict[int, int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers, data, offsets) of groups of whole texts."""
    held, size = [], 0
    for i, text in enumerate(texts):
        if i not in skip:
            held.append(i)
            size += len(text)
        if held and (size >= STEP_BYTES or i + 1 == len(texts)):
            yield held, np.frombuffer(b"".join(texts[k] for k in held), np.uint8), np.cumsum([0, *(len(texts[k]) for k in held)])
            held, size = [], 0
    if held:
        yield held, np.frombuffer(b"".join(texts[k] for k in held), np.uint8), np.cumsum([0, *(len(texts[k]) for k in held)])


def _band_counts(parts: int, how: dict):
    """A bucket's band names by part, each once a text."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, _ = texts_of(left)
        names, owners = [], []
        for numbers, data, offsets in _steps(texts, skipped(keys, texts, right)):
            p = paragraphs_of(data, offsets, **how)
            if len(p.owner):
                one_each, *_ = distinct_paragraphs(p)
                bands = signatures(p.shingles, p.first[one_each], p.last[one_each])
                names.append(bands.reshape(-1))
                owners.append(np.repeat(np.array(numbers)[p.owner[one_each]], bands.shape[1]))
        if not names:
            return pa.Table.from_batches([], schema=packed.ARROW)
        name, owner = tokens.distinct(np.concatenate(names), np.concatenate(owners))
        batch = packed.deal(left.column("bucket")[0].as_py(), name, owner, b"", parts)
        return pa.Table.from_batches([batch.slice(0, batch.num_rows - 1)])  # without the table, which comes last

    return one


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the bytes of `data`, cut after each of `ends` numbers."""
    offsets = np.concatenate([[0], ends * data.dtype.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each `first` to before its `last`, one range after another."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _candidates(parts: int, how: dict):
    """A bucket's paragraphs that share a band with another document's, with their shingles and those bands."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, _ = texts_of(left)
        back = [(part, packed.unblob(blob, np.uint16, np.uint32, np.uint16)[1]) for part, kind, blob in zip(*(right.column(c).to_pylist() for c in ("part", "is_table", "blob"))) if not kind]
        if not back or not keys:
            return pa.Table.from_batches([], schema=_SETS_ARROW)
        shared = np.sort(np.concatenate([low.astype(np.uint64) | np.uint64(part << 32) for part, low in back]))
        bucket, out, made, ids = left.column("bucket")[0].as_py(), [], 0, np.array(keys, np.int64)
        for numbers, data, offsets in _steps(texts, skipped(keys, texts, right)):
            p = paragraphs_of(data, offsets, **how)
            if not len(p.owner):
                continue
            one_each, spans, edges = distinct_paragraphs(p)
            bands = signatures(p.shingles, p.first[one_each], p.last[one_each])
            names = (bands & np.uint64(0xFFFFFFFF)) | (packed.part_of(bands.reshape(-1), parts).astype(np.uint64) << np.uint64(32)).reshape(bands.shape)
            good = tokens.among(names, shared)
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            of, who = one_each[some], np.array(numbers)[p.owner[one_each[some]]]
            # The distinct shingles of each, by 32 bits.
            words, owner = tokens.distinct(p.shingles[_ranges(p.first[of], p.last[of])].astype(np.uint32).astype(np.uint64), np.repeat(np.arange(len(of)), p.last[of] - p.first[of]))
            n = np.bincount(owner, minlength=len(of))
            begin = np.cumsum(n) - n
            digest = np.stack([np.bitwise_xor.reduceat(tokens.mix(words, 3), begin), np.add.reduceat(tokens.mix(words, 4), begin)], axis=1)
            places = spans[_ranges(edges[some], edges[some + 1])] - np.repeat(offsets[p.owner[of]], np.diff(edges)[some])[:, None]
            met = good[some]
            columns = [
                (bucket << 24) + made + np.arange(len(of)), ids[who], np.full(len(of), bucket), who.astype(np.int32), _binary(places.astype("<i8"), 2 * np.cumsum(np.diff(edges)[some])), n, -met.sum(axis=1),
                _binary(digest, 2 * np.arange(1, len(of) + 1)), _binary(words.astype(np.uint32), np.cumsum(n)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32)), _binary(names[some][met], np.cumsum(met.sum(axis=1)))),
            ]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SETS_ARROW)], schema=_SETS_ARROW))
            made += len(of)
        return pa.Table.from_batches(out, schema=_SETS_ARROW)

    return one


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found, n = np.unique(np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_pydict({"token": found.astype(np.int64), "m": n.astype(np.int64)})


def _with_rarest(batches: Iterator[pa.RecordBatch], percent: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Before the bands in prefixes, the shingles of which two alike paragraphs share one: the rarest, ties by hash."""
    for batch in batches:
        out = []
        for data, bands in zip(batch.column("tokens").to_pylist(), batch.column("prefixes").to_pylist()):
            own = np.frombuffer(data, np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
            often = np.where(frequent[at] == own, counts[at], 0) if len(frequent) else np.zeros(len(own), np.int64)
            order = np.lexsort((tokens.mix(own.astype(np.uint64), 20), often))
            out.append([own[order[: len(own) - -(-percent * len(own) // 100) + 1]].tobytes(), *bands])
        yield batch.set_column(batch.schema.get_field_index("prefixes"), "prefixes", pa.array(out, pa.list_(pa.binary())))


def with_rarest(sets: DataFrame, percent: int) -> DataFrame:
    """`sets` with the rarest shingles of each before its bands."""
    counts = sets.select("tokens").mapInArrow(_counted, "token long, m long").groupBy("token").agg(F.sum("m").alias("m")).where("m > 8")
    rows = counts.orderBy(F.desc("m"), "token").limit(FREQUENT).toPandas().sort_values("token")
    frequent, often = rows["token"].to_numpy(np.int64), rows["m"].to_numpy(np.int64)
    return sets.mapInArrow(lambda b: _with_rarest(b, percent, frequent, often), sets.schema)


def repeated_paragraphs(texts: DataFrame, copies: DataFrame, parts: int, percent: int = PERCENT, **how) -> DataFrame:
    """chunk, who, spans, first of the paragraphs of a document, equal ones in one row, whose component has one of a document with a smaller id, `first` the smallest; spans has the start and stop of each place."""
    counted = texts.groupBy("bucket").cogroup(copies.groupBy("chunk")).applyInArrow(_band_counts(parts, how), packed.SCHEMA)
    shared = packed.by_part(counted, parts).mapInArrow(packed.shared, packed.SCHEMA)
    sets = stash(texts.groupBy("bucket").cogroup(shared.unionByName(copies).groupBy("chunk")).applyInArrow(_candidates(parts, how), _SETS), "paragraphs")
    classes = stash(sets.groupBy("digest", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "classes")
    same = stash(sets.select("key", "n", "digest").join(classes, ["digest", "n"]).where("key != first").select(F.col("first").alias("u"), F.col("key").alias("v")), "same")
    firsts = stash(sets.join(same.select(F.col("v").alias("key")), "key", "left_anti").select("key", "n", F.col("n").alias("shared"), "rank", "tokens", "prefixes"), "firsts")
    rows = stash(sets.select("key", "id", "chunk", "who", "spans"), "rows")
    old, firsts = firsts, stash(with_rarest(firsts, percent), "firsts")
    dropped(old, sets, classes)
    near = components(stash(near_links(firsts, percent, np.uint32, LITTLE), "near"), little=LITTLE)
    of_same = same.join(near, same["u"] == near["node"], "left").select(F.col("v").alias("node"), F.coalesce("component", "u").alias("component"))
    of_first = same.select("u").distinct().join(near, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    labels = stash(near.unionByName(of_same).unionByName(of_first), "labels")
    named = stash(rows.join(labels, rows["key"] == labels["node"]).select("id", "chunk", "who", "spans", "component"), "named")
    least = stash(named.groupBy("component").agg(F.min("id").alias("first")), "first")
    return named.join(least, "component").where("id > first").select("chunk", "who", "spans", "first")


_CUT = "id long, n_bytes long, n_removed long, n_spans long, partners array<long>, kept binary, rows long"
_CUT_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("partners", pa.list_(pa.int64())), ("kept", pa.binary()), ("rows", pa.int64())])


def _cut(how: dict, digest: bool):
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, rows = texts_of(left)
        skip = skipped(keys, texts, right)
        gone: dict[int, list[tuple[int, int, int]]] = {}
        for kind, who, spans, first in zip(*(right.column(c).to_pylist() for c in ("is_table", "who", "spans", "first"))):
            if not kind:
                gone.setdefault(who, []).extend((start, stop, first) for start, stop in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist())
        out = []
        for i, (key, text, times) in enumerate(zip(keys, texts, rows)):
            spans = gone.get(i, [])
            if i in skip:
                p = paragraphs_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), **how)
                spans = [(a, z, skip[i]) for a, z in zip(p.start.tolist(), p.stop.tolist())]
            kept, at, removed, runs = [], 0, 0, 0
            for a, z, _ in sorted(spans):
                if z > at:
                    runs += a > at or not runs
                    kept.append(text[at : max(a, at)])
                    removed += z - max(a, at)
                    at = z
            kept = b"".join([*kept, text[at:]])
            out.append((None if key == NO_ID else key, len(text), removed, runs, sorted({f for *_, f in spans}), hashlib.sha256(kept).digest() if digest else kept, times))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT_ARROW)], schema=_CUT_ARROW) if out else pa.Table.from_batches([], schema=_CUT_ARROW)

    return one


def cut_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, digest: bool = False, **how) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, partners, kept (the bytes left, or with `digest` their SHA-256) for every row.

    Two paragraphs are alike from a Jaccard similarity of percent / 100 of their
    distinct word shingles on; components of alike ones hang together. A
    paragraph goes if its component has one of a document with a smaller id;
    repeats within one document stay. n_spans counts the runs of removed bytes;
    partners are, ascending, the smallest ids of the components that the removed
    paragraphs are in; a copy of a whole text names the least id that has it.
    Bands find nearly all alike pairs; of those that share a band, none between
    different components goes untested. Texts of fewer than min_words words have
    no paragraphs; null is empty; a null id is larger than any other. Rows that
    repeat an id don't take from each other. No rows give no rows.
    """
    texts, copies, parts = dealt(docs, id_col, text_col)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    gone = repeated_paragraphs(texts, copies, parts, percent, **how).select("chunk", F.lit(False).alias("is_table"), "who", "spans", "first", none("blob", "binary"))
    listed = copies.select("chunk", "is_table", none("who", "int"), none("spans", "binary"), none("first", "long"), "blob")
    cut = texts.groupBy("bucket").cogroup(gone.unionByName(listed).groupBy("chunk")).applyInArrow(_cut(how, digest), _CUT)
    return each_row(cut).withColumnRenamed("id", id_col)


def remove_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with the removed paragraphs cut from the text. Ids must be unique; rows with a null id stay as they are."""
    cut = cut_paragraphs(docs, id_col, text_col, **how).where("n_removed > 0").select(F.col(id_col).alias("id"), F.col("kept").cast("string").alias("kept"))
    # The row travels as one column, so no name of its own can clash.
    joined = docs.select(F.col(id_col).alias("of"), F.struct(*docs.columns).alias("row")).join(cut, F.col("of") == F.col("id"), "left")
    return joined.select(*[F.coalesce("kept", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
