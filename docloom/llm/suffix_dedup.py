"""Suffix-array dedup: repeated strings of a fixed length, found by two-stage suffix sorting.

Every string of `length` bytes has one anchor: the substring of ANCHOR bytes with
the least hash in it. Equal strings have equal anchors, so it is enough to look
for them among the strings with one anchor. Anchors are counted over the corpus;
the strings around those that several documents have are sent, as short contexts
of the text, to the part that their anchor falls to. There, the contexts are
suffix-sorted in two stages and adjacent common prefixes give the repeated
strings and the least document that has each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import packed, tokens
from docloom.llm.buckets import NO_ID, dealt, each_row, skipped, texts_of

LENGTH = 50
#: So long that hardly any are shared by chance, and short enough for each to stand for many strings.
ANCHOR = 24
#: Bits of a position in the number that a minimum is taken of; the others are the hash's.
_POS_BITS = 28
#: Bytes of text that one step works on, and context bytes that are sorted at once.
STEP_BYTES, SORT_BYTES = 2 << 20, 1 << 20
#: An anchor of so many texts has its strings sent one by one.
HOT = 255


# --- two-stage suffix sorting ------------------------------------------------


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix of `text` whether it is smaller than the next; the end is smaller than all."""
    n = len(text)
    change = np.ones(n, bool)  # the last of a run of equal symbols
    change[:-1] = text[1:] != text[:-1]
    ends = np.flatnonzero(change)
    after = np.zeros(len(ends), np.int16) - 1
    after[:-1] = text[ends[:-1] + 1]
    rises = text[ends].astype(np.int16) < after
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends])))


def packs(text: np.ndarray) -> np.ndarray:
    """The 8 symbols from each place on as one number, zeros past the end."""
    p = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        p[:-shift] = (p[:-shift] << np.uint64(8 * shift)) | p[shift:]
    return p[: len(text)]


def _directly_sorted(places: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """`places` by the `depth` symbols from each, at least; equal ones keep their order."""
    at = lambda p, k: np.where(p + k < len(eight), eight[np.minimum(p + k, len(eight) - 1)], np.uint64(0))
    order = places[np.argsort(at(places, 0), kind="stable")]
    key = at(order, 0)
    tied = np.zeros(len(order), bool)
    group = np.zeros(len(order), np.int64)
    same = key[1:] == key[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group[1:] = np.cumsum(~same)
    where = np.flatnonzero(tied)
    for k in range(8, depth, 8):
        if not len(where):
            break
        sub, g = order[where], group[where]
        key = at(sub, k)
        turn = np.lexsort((key, g))
        sub, key, g = sub[turn], key[turn], g[turn]
        order[where] = sub
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        still = np.zeros(len(sub), bool)
        still[1:] |= same
        still[:-1] |= same
        new = np.zeros(len(sub), np.int64)
        new[1:] = np.cumsum(~same)
        group[where] = new
        where = where[still]
    return order


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of `text` (bytes) by the suffixes there, right to `depth` symbols at least.

    Stage one sorts only the suffixes that are smaller than their successors.
    Stage two scans the buckets of first symbols in order: whatever stands at a
    place puts the suffix before it, if larger than its successor, at the head of
    that one's bucket. All of a bucket that is already there is scanned at once.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    first = np.flatnonzero(small)
    sorted_small = _directly_sorted(first, packs(text), depth + 8)
    counts = np.bincount(text, minlength=256)
    starts = np.cumsum(counts) - counts
    head = starts.copy()
    small_counts = np.bincount(text[first], minlength=256)
    out = np.empty(n, np.int64)
    tails = starts + counts - small_counts
    rank = np.cumsum(small_counts) - small_counts
    for c in np.flatnonzero(small_counts):
        out[tails[c] : starts[c] + counts[c]] = sorted_small[rank[c] : rank[c] + small_counts[c]]

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[~small[before]]
        symbols = text[before]
        turn = np.argsort(symbols, kind="stable")
        before = before[turn]
        got = np.bincount(symbols, minlength=256)
        at = 0
        for c in np.flatnonzero(got):
            out[head[c] : head[c] + got[c]] = before[at : at + got[c]]
            head[c] += got[c]
            at += got[c]

    induce(np.array([n]))  # the end stands before all suffixes
    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < head[c]:
            until = head[c]
            induce(out[done:until])
            done = until
        induce(out[tails[c] : starts[c] + counts[c]])
    return out


def common_prefix_at_least(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at order[i] and order[i + 1] share their first `length` symbols."""
    eight = packs(text)
    a, b = order[:-1], order[1:]
    equal = (a + length <= len(text)) & (b + length <= len(text))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        left = np.flatnonzero(equal)
        equal[left] = eight[a[left] + k] == eight[b[left] + k]
    return equal


# --- anchors -----------------------------------------------------------------


class Contexts(NamedTuple):
    """Runs of string starts with one anchor: text number, first start in it, number of starts, anchor's hash."""

    owner: np.ndarray
    start: np.ndarray
    count: np.ndarray
    token: np.ndarray


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Contexts:
    """Every string of `length` bytes within a text, by its anchor; data has fewer than 2 ** 28 bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Contexts(none, none, none, np.zeros(0, np.uint64))
    up, down = tokens._tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens.BYTE_CODES[data] * up[:n], out=sums[1:])
    hashes = (sums[anchor:] - sums[: n - anchor + 1]) * down[: n - anchor + 1]
    hashes = tokens.mix(hashes, 31)
    low = np.uint64((1 << _POS_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - anchor + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    # least[s]: the anchor of the string at s. Strings must lie within a text.
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length <= offsets[1:][owner]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return Contexts(none, none, none, np.zeros(0, np.uint64))
    place = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    return Contexts(owner[first], first - offsets[owner[first]], count, hashes[place[begin]])


# --- the distributed part ----------------------------------------------------


def _steps(texts: list[bytes], skip: dict[int, int], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, text number, base) of groups of texts; a very long text comes in overlapping pieces."""
    held, size = [], 0

    def close():
        data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        offsets = np.cumsum([0, *(len(h[2]) for h in held)])
        return data, offsets, np.array([h[0] for h in held]), np.array([h[1] for h in held])

    for i, text in enumerate(texts):
        if i in skip or len(text) < length:
            continue
        for base in range(0, max(1, len(text) - length + 1), STEP_BYTES):
            piece = text[base : base + STEP_BYTES + length - 1]
            held.append((i, base, piece))
            size += len(piece)
            if size >= STEP_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _empty() -> pa.Table:
    return pa.Table.from_batches([], schema=packed.ARROW)


def _count_anchors(parts: int, length: int):
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, _ = texts_of(left)
        found = [[], []]
        for data, offsets, number, _ in _steps(texts, skipped(keys, texts, right), length):
            c = contexts_of(data, offsets, length)
            found[0].append(c.token)
            found[1].append(number[c.owner])
        if not found[0]:
            return _empty()
        owner = np.concatenate(found[1])
        token, owner = tokens.distinct(np.concatenate(found[0]), owner)
        bucket = left.column("bucket")[0].as_py()
        batch = packed.deal(bucket, token, owner, b"", parts)
        return pa.Table.from_batches([batch.filter(pc.invert(batch.column("is_table")))])

    return one


#: What a bucket sends to a part: name of the anchor (low 32 bits), text number, first start, number of starts; then a table of ids and the compressed bytes.
_SENT = (np.uint32, np.uint16, np.uint32, np.uint8)
_CODEC = "zstd"


def _send(bucket: int, keys: np.ndarray, names: np.ndarray, who: np.ndarray, start: np.ndarray, count: np.ndarray, blobs: list[bytes], parts: int, out: list) -> None:
    part = packed.part_of(names, parts)
    order = np.lexsort((names, part))  # contexts of one anchor next to one another compress well
    ends = np.cumsum(np.bincount(part, minlength=parts))
    begins = np.concatenate([[0], ends[:-1]])
    for p in np.flatnonzero(ends > begins):
        take = order[begins[p] : ends[p]]
        used, local = np.unique(who[take], return_inverse=True)
        head = packed.blob(names[take].astype(np.uint32), local.astype(np.uint16), start[take].astype(np.uint32), count[take].astype(np.uint8))
        text = pa.compress(b"".join(blobs[i] for i in take.tolist()), _CODEC, asbytes=True)
        out.append((bucket, int(p), False, head + packed.blob(used.astype(np.uint16), keys[used]) + text))


def _spans_blob(who: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    return packed.blob(who.astype(np.uint16), start.astype(np.uint32), count.astype(np.uint8))


def _send_contexts(parts: int, length: int):
    """The contexts around shared anchors. Of equal contexts in a bucket only the least document's is sent.

    The others are settled here, since a smaller document has all their strings.
    The strings of a hot anchor go one by one, each by its own hash: however many
    documents have a string, a part gets it once a bucket at most.
    """

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, _ = texts_of(left)
        skip = skipped(keys, texts, right)
        shared: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        for part, is_table, data in zip(right.column("part").to_pylist(), right.column("is_table").to_pylist(), right.column("blob").to_pylist()):
            if not is_table:
                who, low, counts = packed.unblob(data, np.uint16, np.uint32, np.uint16)
                name = low.astype(np.uint64) | np.uint64(part << 32)
                shared.append(name)
                hot.append(name[counts >= HOT])
        if not shared or not len(keys):
            return _empty()
        shared_names, hot_names = np.sort(np.concatenate(shared)), np.sort(np.concatenate(hot))
        bucket, out = left.column("bucket")[0].as_py(), []
        ids, rank = np.array(keys, np.int64), np.unique(np.array(keys, np.int64), return_inverse=True)[1]
        gathered: list[tuple] = []
        for data, offsets, number, base in _steps(texts, skip, length):
            c = contexts_of(data, offsets, length)
            name = (c.token & np.uint64(0xFFFFFFFF)) | (packed.part_of(c.token, parts).astype(np.uint64) << np.uint64(32))
            keep = tokens.among(name, shared_names)
            owner, start, count, name = c.owner[keep], c.start[keep], c.count[keep], name[keep]
            begin = offsets[owner] + start
            is_hot = tokens.among(name, hot_names)
            if is_hot.any():
                # One string each, named by itself.
                b, k = begin[is_hot], count[is_hot]
                each = np.repeat(b - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                h = tokens.spans(data, each, each + length)
                by_self = (h & np.uint64(0xFFFFFFFF)) | (packed.part_of(h, parts).astype(np.uint64) << np.uint64(32))
                o = np.repeat(owner[is_hot], k)
                owner, begin = np.concatenate([owner[~is_hot], o]), np.concatenate([begin[~is_hot], each])
                count, name = np.concatenate([count[~is_hot], np.ones(len(each), np.int64)]), np.concatenate([name[~is_hot], by_self])
                start = begin - offsets[owner]
            whole = tokens.spans(data, begin, begin + count + length - 1)
            raw = data.tobytes()
            gathered.append((number[owner], base[owner] + start, count, name, whole, [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist())]))
        if not gathered:
            return _empty()
        who, start, count, name, whole = (np.concatenate([g[k] for g in gathered]) for k in range(5))
        blobs = [b for g in gathered for b in g[5]]
        # Rows come by id, so the first of equal contexts has the least id.
        order = np.argsort(who, kind="stable")
        _, first, inverse = np.unique(whole[order], return_index=True, return_inverse=True)
        like = np.empty(len(who), np.int64)  # the context of least id with the same hash
        like[order] = order[first][inverse]
        settled = rank[who] > rank[who[like]]
        settled[[i for i in np.flatnonzero(settled).tolist() if blobs[i] != blobs[like[i]]]] = False
        if settled.any():
            out.append((bucket, bucket % parts, True, _spans_blob(who[settled], start[settled], count[settled])))
        rest = np.flatnonzero(~settled)
        if len(rest):
            _send(bucket, ids, name[rest], who[rest], start[rest], count[rest], [blobs[i] for i in rest.tolist()], parts, out)
        return pa.Table.from_batches([packed.rows(*map(list, zip(*out)))]) if out else _empty()

    return one


def _least_documents(data: np.ndarray, begin: np.ndarray, count: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each string of the contexts at `begin` (count strings each, least document `least`): the least document of all equal ones."""
    sizes = count + length - 1
    spaced = sizes + 1
    at = np.cumsum(spaced) - spaced
    text = np.zeros(int(spaced.sum()), np.uint8)
    inner = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text[inner] = data[source] + 1  # 0 divides contexts; no byte of UTF-8 is 255
    order = suffix_order(text, length)
    string = np.full(len(text), -1, np.int64)
    places = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    string[places] = np.arange(len(places))
    owner = np.repeat(least, count)
    order = order[string[order] >= 0]
    equal = common_prefix_at_least(text, order, length)
    group = np.concatenate([[0], np.cumsum(~equal)])
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    lowest = np.minimum.reduceat(owner[string[order]], first)
    out = np.empty(len(places), np.int64)
    out[string[order]] = lowest[group]
    return out


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether data[a:a + n] is data[b:b + m], for each entry."""
    equal = n == m
    for at in range(0, len(a), 20_000):
        k = slice(at, at + 20_000)
        here = np.flatnonzero(equal[k]) + at
        inner = np.arange(int(n[here].sum())) - np.repeat(np.cumsum(n[here]) - n[here], n[here])
        differ = data[np.repeat(a[here], n[here]) + inner] != data[np.repeat(b[here], n[here]) + inner]
        equal[np.unique(np.repeat(here, n[here])[differ])] = False
    return equal


def _resolve_part(rows: list[tuple[int, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """Of one part's contexts: the strings of each bucket that a smaller document has."""
    names, who, keys, start, count, bucket, begin, chunks, size = [], [], [], [], [], [], [], [], 0
    for b, data in rows:
        name, local, s, c = packed.unblob(data, *_SENT)
        at = 8 + len(name) * sum(np.dtype(t).itemsize for t in _SENT)
        used, ids = packed.unblob(memoryview(data)[at:], np.uint16, np.int64)
        at += 8 + len(used) * 10
        c = c.astype(np.int64)
        lengths = c + length - 1
        for to, x in ((names, name), (who, used[local]), (keys, ids[local]), (start, s), (count, c), (bucket, np.full(len(name), b)), (begin, size + np.cumsum(lengths) - lengths)):
            to.append(x)
        total = int(lengths.sum())
        chunks.append(np.frombuffer(pa.decompress(memoryview(data)[at:], total, _CODEC), np.uint8))
        size += total
    names, who, keys, start, count, bucket, begin = map(np.concatenate, (names, who, keys, start, count, bucket, begin))
    data = np.concatenate(chunks)
    whole = np.empty(len(names), np.uint64)
    for a in range(0, len(names), 20_000):  # running sums over one stretch of bytes at a time
        z = min(a + 20_000, len(names))
        lo, hi = int(begin[a]), int(begin[z - 1] + count[z - 1] + length - 1)
        whole[a:z] = tokens.spans(data[lo:hi], begin[a:z] - lo, begin[a:z] + count[a:z] + length - 1 - lo)
    # Equal contexts are one, with the least document of all.
    order = np.lexsort((keys, whole, names))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (names[order][1:] != names[order][:-1])
    same = np.flatnonzero(~new)  # told by hash so far; the bytes decide
    new[same] = ~_equal_bytes(data, begin[order[same - 1]], begin[order[same]], count[order[same - 1]] + length - 1, count[order[same]] + length - 1)
    firsts = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    least = keys[firsts]
    # Strings can only be equal across contexts of one anchor.
    anchor = names[firsts]
    change = np.ones(len(firsts), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    group = np.cumsum(change) - 1
    mixed = np.bincount(group)[group] > 1
    sizes = count[firsts] + length
    string_first = np.cumsum(count[firsts]) - count[firsts]
    lowest = np.repeat(least, count[firsts])
    todo = np.flatnonzero(mixed)
    at = 0
    while at < len(todo):
        # Whole anchors up to about SORT_BYTES of context.
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[todo[at:]]), SORT_BYTES, side="right")))
        while stop < len(todo) and group[todo[stop]] == group[todo[stop - 1]]:
            stop += 1
        some = todo[at:stop]
        found = _least_documents(data, begin[firsts[some]], count[firsts[some]], least[some], length)
        c = count[firsts[some]]
        lowest[np.repeat(string_first[some] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))] = found
        at = stop
    # Each context's strings against its own document, as runs.
    c = count
    each = np.repeat(np.arange(len(c)), c)
    inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    gone = lowest[string_first[which[each]] + inner] < keys[each]
    each, inner = each[gone], inner[gone]
    if not len(each):
        return
    new = np.ones(len(each), bool)
    new[1:] = (each[1:] != each[:-1]) | (inner[1:] != inner[:-1] + 1)
    run = np.flatnonzero(new)
    lengths = np.diff(np.append(run, len(each)))
    of, at0 = each[run], start[each[run]].astype(np.int64) + inner[run]
    turn = np.argsort(bucket[of], kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[of][turn]) != 0]))
    for a, z in zip(edges, np.append(edges[1:], len(turn))):
        take = turn[a:z]
        yield packed.rows([int(bucket[of[take[0]]])], [0], [False], [_spans_blob(who[of[take]], at0[take], lengths[take])])


def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for chunk, part, settled, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "is_table", "blob"))):
            if settled:
                yield packed.rows([chunk], [0], [False], [data])
            else:
                held.setdefault(part, []).append((chunk, data))
    for part in list(held):
        yield from _resolve_part(held.pop(part), length)


_CUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, rows long"
_CUT_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("rows", pa.int64())])


def _cut(length: int, digest: bool):
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, rows = texts_of(left)
        skip = skipped(keys, texts, right)
        spans = [packed.unblob(d, np.uint16, np.uint32, np.uint8) for t, d in zip(right.column("is_table").to_pylist(), right.column("blob").to_pylist()) if not t]
        who, start, count = (np.concatenate([s[k] for s in spans]).astype(np.int64) if spans else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(who, kind="stable")
        first = np.searchsorted(who[order], np.arange(len(keys) + 1))
        out = []
        for i, (key, text, times) in enumerate(zip(keys, texts, rows)):
            n, here = len(text), order[first[i] : first[i + 1]]
            if i in skip and n >= length:
                removed, runs, kept = n, 1, b""
            elif len(here):
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, start[here], 1)
                np.add.at(marks, start[here] + count[here] + length - 1, -1)
                covered = np.cumsum(marks[:-1]) > 0
                removed, runs = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            else:
                removed, runs, kept = 0, 0, text
            out.append((None if key == NO_ID else key, n, removed, runs, hashlib.sha256(kept).digest() if digest else kept, times))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT_ARROW)], schema=_CUT_ARROW) if out else pa.Table.from_batches([], schema=_CUT_ARROW)

    return one


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes left, or with `digest` their SHA-256) for every row.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of `length`
    bytes covers it that starts in a text with a smaller id too; strings are
    judged on the input. n_spans counts the runs of removed bytes. Texts shorter
    than `length` stay whole. Rows that repeat an id don't take from each other;
    a null id counts as larger than any other. No rows give no rows.

    Texts are shuffled once, to buckets by a hash of id and text, and that exchange
    is read by three steps. Buckets are as many as the bytes of all texts ask for. Copies of a whole text are settled by its digest, so that
    large groups of them are no work, and rows that repeat id and text are one.
    `length` must lie between 24 and 200.
    """
    texts, copies, parts = dealt(docs, id_col, text_col)
    counted = texts.groupBy("bucket").cogroup(copies.groupBy("chunk")).applyInArrow(_count_anchors(parts, length), packed.SCHEMA)
    shared = packed.by_part(counted, parts).mapInArrow(packed.shared, packed.SCHEMA)
    sent = texts.groupBy("bucket").cogroup(shared.unionByName(copies).groupBy("chunk")).applyInArrow(_send_contexts(parts, length), packed.SCHEMA)
    spans = packed.by_part(sent, parts).mapInArrow(lambda b: _resolve(b, length), packed.SCHEMA)
    cut = texts.groupBy("bucket").cogroup(spans.unionByName(copies).groupBy("chunk")).applyInArrow(_cut(length, digest), _CUT)
    return each_row(cut).withColumnRenamed("id", id_col)
