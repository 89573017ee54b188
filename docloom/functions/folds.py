"""Folds over sizes of parts: plain Python. A plan has several of them, each with a worker, so nothing large is imported here."""

from __future__ import annotations

from collections.abc import Iterable

RUNS = "array<struct<first:int,last:int,named:int>>"

#: What becomes of a part over the limit: it is cut further after what is open was closed (STRICT), only where nothing is open (LOOSE), or never (NEVER).
STRICT, LOOSE, NEVER = 0, 1, 2


def runs_of(sizes: Iterable[int], limit: int, overlap: int, seed: int, how: int) -> list[tuple[int, int, int]]:
    """(first, last, 1 if the part is to be cut further): parts packed in order up to `limit`.

    A closed chunk's last parts, up to `overlap`, begin the next one, which counts
    `seed` more.
    """
    sizes, out = list(sizes), []
    first, used = 0, 0
    held = 0  # parts of the open chunk, that end before i
    for i, n in enumerate(sizes):
        if n > limit and (how == STRICT or how == LOOSE and not held):
            if held:
                out.append((first, i - 1, 0))
            out.append((i, i, 1))
            held, used = 0, 0
            continue
        if held and used + n > limit:
            out.append((first, i - 1, 0))
            spare, start = overlap, i
            while start > first and sizes[start - 1] <= spare:
                start -= 1
                spare -= sizes[start]
            held, first, used = i - start, start, overlap - spare + seed
        if not held:
            first = i
        held += 1
        used += n
    if held:
        out.append((first, len(sizes) - 1, 0))
    return out


def merged_sections(lengths: Iterable[int], least: int, limit: int) -> list[tuple[int, int, int]]:
    """(first, last, the section that names it): one that is under `least` when it comes takes in the next ones while they fit."""
    size = lambda n: max(1, n // 4)
    out: list[list[int]] = []
    joined, open_ = 0, False
    for i, n in enumerate(lengths):
        if open_ and size(joined + 2 + n) <= limit:
            if size(n) > size(joined):
                out[-1][2] = i
            out[-1][1] = i
            joined += 2 + n
            continue
        out.append([i, i, i])
        joined, open_ = n, size(n) < least
    return [tuple(r) for r in out]


def neighbours(lengths: Iterable[int], limit: int) -> list[tuple[int, int, int]]:
    """(first, last, 0): neighbours joined while they fit together."""
    out: list[list[int]] = []
    joined = 0
    for i, n in enumerate(lengths):
        if out and max(1, (joined + 2 + n) // 4) <= limit:
            out[-1][1] = i
            joined += 2 + n
        else:
            out.append([i, i, 0])
            joined = n
    return [tuple(r) for r in out]


def ancestors(levels: Iterable[int]) -> list[list[int]]:
    """For each section the sections whose headings are above it and its own, -1 for a level that none has; level 0 is no heading."""
    stack: list[int] = []
    out = []
    for i, level in enumerate(levels):
        if level:
            stack = (stack + [-1] * level)[: level - 1] + [i]
        out.append(list(stack))
    return out


def named(runs: list | None) -> list[dict] | None:
    """Runs as rows of RUNS."""
    return None if runs is None else [dict(zip(("first", "last", "named"), r)) for r in runs]
