"""Words and word shingles of a batch of texts as arrays, without a Python loop over words.

Texts come as an Arrow string array; its UTF-8 bytes are worked on in place. A
word is a run of bytes other than space and tab to carriage return, with A-Z in
lower case where asked. Hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16
#: Bytes of text that one step works on; an array of 8 bytes for each is held a few times.
STEP_BYTES = 4 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 7)
FOLDED_CODES = BYTE_CODES[FOLD]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
        filled += take
    return out


_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        _CACHE["up"], _CACHE["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _CACHE["up"], _CACHE["down"]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


class Words(NamedTuple):
    """starts, ends: bytes of each word in the data; hashes; first: for each text the index of its first word, and the end."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    # Texts touch in the data, so a word also starts where a text does.
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, spans(data, starts, ends, fold), np.searchsorted(starts, offsets))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of data[starts:ends]: a polynomial of the bytes, taken from running sums.

    Starts ascend. Longer data is taken in windows of some STEP_BYTES, and a span
    that is longer itself in pieces, so tables and sums stay as small as for a step.
    """
    if len(data) > STEP_BYTES:
        return _spans_of_long(data, starts, ends, fold)
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((FOLDED_CODES if fold else BYTE_CODES)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts], 1) + (ends - starts).astype(np.uint64)


def _spans_of_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > STEP_BYTES // 2)
    codes, (up, _) = FOLDED_CODES if fold else BYTE_CODES, _tables(1)
    for i in long.tolist():
        total, step = np.uint64(0), STEP_BYTES // 2
        for at in range(int(starts[i]), int(ends[i]), step):
            piece = data[at : min(at + step, int(ends[i]))]
            with np.errstate(over="ignore"):
                total += np.sum(codes[piece] * up[: len(piece)], dtype=np.uint64) * np.uint64(pow(_BASE, at - int(starts[i]), 1 << 64))
        out[i] = mix(np.array([total]), 1)[0] + np.uint64(ends[i] - starts[i])
    short = np.flatnonzero(ends - starts <= STEP_BYTES // 2)
    at = 0
    while at < len(short):
        low = int(starts[short[at]])
        stop = max(at + 1, int(np.searchsorted(starts[short], low + STEP_BYTES // 2)))
        own = short[at:stop]
        high = int(ends[own].max())
        out[own] = spans(data[low:high], starts[own] - low, ends[own] - low, fold)
        at = stop
    return out


def shingles(found: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): every run of `size` words, and the text it is in; not distinct.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    first, hashes = found.first, found.hashes
    counts = np.diff(first)
    n = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    short = counts[owner] < size
    left = first[1:][owner] - np.arange(n)  # words from here to the text's end
    total = np.zeros(n, np.uint64)
    for i in range(min(size, n)):
        part = np.zeros(n, np.uint64)
        part[: n - i] = mix(hashes[i:], i + 2)
        total += np.where(left > i, part, np.uint64(0))
    keep = (left >= size) | (short & (left == counts[owner]))
    lengths = np.minimum(counts[owner], size).astype(np.uint64)
    return mix(total[keep] + lengths[keep], 99), owner[keep]


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, hash) pairs, by owner and then hash; owner comes in ascending order."""
    order = np.argsort(hashes)
    if len(owner) and owner[-1] < 1 << 16:  # 16-bit keys are sorted in linear time
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each of `values` is in `ascending`, which may repeat numbers."""
    if not len(ascending):
        return np.zeros(values.shape, bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def steps(texts: pa.Array, size: int = STEP_BYTES):
    """Slices (start, stop) of a string array of about `size` bytes each, or one longer text."""
    _, offsets = utf8(texts)
    at, n = 0, len(texts)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(stop, n)
        at = min(stop, n)
