"""Chunkers of single texts in plain Python: what the chunks of Spark are held against."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator


def size_of(text: str) -> int:
    return max(1, len(text) // 4)


def packed(parts: list[str], joint: str, limit: int, overlap: int, oversize: Callable[[str], list[str]], seed: int = 0, first: int = 0, strict: bool = True) -> Iterator[tuple[str, bool]]:
    """(chunk, whether it was packed): parts in order, packed up to `limit` tokens.

    A closed chunk's last parts, up to `overlap` tokens, begin the next one, which
    counts `seed` more tokens. A part over the limit is handed to `oversize`; with
    `strict` it first closes what is open, without it only an empty buffer does so.
    """
    held: list[str] = []
    used = first
    for part in parts:
        n = size_of(part)
        if n > limit and (strict or not held):
            if held:
                yield joint.join(held), True
            held, used = [], 0
            for piece in oversize(part):
                yield piece, False
            continue
        if held and used + n > limit:
            yield joint.join(held), True
            tail: list[str] = []
            spare = overlap
            for back in reversed(held):
                if size_of(back) > spare:
                    break
                tail.insert(0, back)
                spare -= size_of(back)
            held, used = tail, overlap - spare + seed
        held.append(part)
        used += n
    if held:
        yield joint.join(held), True


def windows(text: str, limit: int) -> list[str]:
    return [text[i : i + 4 * limit] for i in range(0, len(text), 4 * limit)]


def by_sentences(text: str, limit: int, overlap: int) -> list[str]:
    parts = re.split(r"(?<=[.?!])\s+", text)
    if len(parts) < 2:
        return windows(text, limit)
    return [c for c, _ in packed(parts, " ", limit, overlap, lambda s: windows(s, limit), strict=False)]


def by_paragraphs(text: str, limit: int, overlap: int) -> list[str]:
    sentences = lambda p: by_sentences(p, limit, overlap)
    chunks = list(packed(re.split(r"\n\n+", text), "\n\n", limit, overlap, sentences))
    if chunks and chunks[-1][1] and size_of(chunks[-1][0]) > limit:
        return [c for c, _ in chunks[:-1]] + sentences(chunks[-1][0])
    return [c for c, _ in chunks]


def sections(markdown: str) -> list[tuple[str, str]]:
    """(heading path, text with its heading) of a Markdown text; `Introduction` before the first heading."""
    stack: list[str] = []
    out: list[tuple[str, str]] = []
    lines: list[str] = []

    def close() -> None:
        text = "\n".join(lines).strip()
        if text:
            out.append((" > ".join(stack) or "Introduction", text))

    for line in markdown.split("\n"):
        found = re.match(r"^(#{1,6})\s+(.+)$", line)
        if found:
            close()
            level = len(found[1])
            stack = (stack + [""] * level)[: level - 1] + [found[2].strip()]
            lines = []
        lines.append(line)
    close()
    return out


def document_chunks(markdown: str, title: str = "", least: int = 200, limit: int = 1500, overlap: int = 100) -> list[tuple[str, str]]:
    """(content, heading path): sections, small ones merged forward while they fit, large ones cut."""
    merged: list[tuple[str, str]] = []
    open_ = False
    for path, text in sections(markdown):
        if open_:
            old_path, old = merged[-1]
            both = f"{old}\n\n{text}"
            if size_of(both) <= limit:
                merged[-1] = (path if size_of(text) > size_of(old) else old_path, both)
                continue
        merged.append((path, text))
        open_ = size_of(text) < least
    out = []
    for path, text in merged:
        full = path if not title or path.startswith(title) else f"{title} > {path}"
        out += [(text, full)] if size_of(text) <= limit else [(c, full) for c in by_paragraphs(text, limit, overlap)]
    return out


def statute_chunks(text: str, citation: str, limit: int = 1500, overlap: int = 100) -> list[str]:
    """A section whole, or packed by its subdivisions, with the citation before all chunks but the first."""
    if not text.strip():
        return []
    if size_of(text) <= limit:
        return [text]
    parts = re.split(r"(?m)(?=^\([a-z]\)\s)", text)
    if len(parts) < 2:
        return by_paragraphs(text, limit, overlap)
    head = f"[{citation}]\n\n"
    lead = parts[0].strip()
    chunks: list[str] = []
    held, used = ([lead], size_of(lead)) if lead else ([], 0)
    for part in parts[1:]:
        if held and used + size_of(part) > limit:
            chunks.append("\n\n".join(held))
            held, used = [], size_of(head)
        held.append(part)
        used += size_of(part)
    chunks.append("\n\n".join(held))
    return chunks[:1] + [head + c for c in chunks[1:]]


def opinion_chunks(text: str, citation: str, limit: int = 1500, overlap: int = 100) -> list[str]:
    """An opinion whole, or packed by paragraphs with overlap, the citation before all chunks but the first."""
    if not text.strip():
        return []
    if size_of(text) <= limit:
        return [text]
    head = f"[{citation}]\n\n"
    chunks = [c for c, _ in packed(re.split(r"\n\n+", text), "\n\n", limit, overlap, lambda p: by_sentences(p, limit, overlap), seed=size_of(head))]
    return chunks[:1] + [head + c for c in chunks[1:]]


def page_chunks(text: str, name: str, limit: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """Form-feed pages, small neighbours merged, with page ranges as headings; blank pages still count."""
    pages = [(i, p.strip()) for i, p in enumerate(text.split("\f"), 1) if p.strip()]
    heading = lambda a, b: f"{name} > Page {a}" if a == b else f"{name} > Pages {a}-{b}"
    out: list[tuple[str, str]] = []
    held: list[str] = []
    first = last = 0
    for i, page in [*pages, (0, "")]:
        if held and (not page or size_of("\n\n".join([*held, page])) > limit):
            whole = "\n\n".join(held)
            out += [(c, heading(first, last)) for c in ([whole] if size_of(whole) <= limit else by_paragraphs(whole, limit, overlap))]
            held = []
        if page:
            first = i if not held else first
            last = i
            held.append(page)
    return out


def sheet_chunks(text: str, name: str, limit: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """`## ` sheets, and what stands before the first."""
    out = []
    for part in re.split(r"(?m)^(?=## )", text):
        if part.strip():
            sheet = re.match(r"## (.+)", part)
            path = f"{name} > {sheet[1].strip()}" if sheet else name
            out += [(c, path) for c in ([part.strip()] if size_of(part.strip()) <= limit else by_paragraphs(part.strip(), limit, overlap))]
    return out


def message_chunks(text: str, name: str, separator: str = "\n---\n", limit: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """One chunk or more a message; the number counts blank messages too."""
    parts = text.split(separator)
    out = []
    for i, part in enumerate(parts, 1):
        if part.strip():
            path = f"{name} > Message {i}" if len(parts) > 1 else name
            out += [(c, path) for c in ([part.strip()] if size_of(part.strip()) <= limit else by_paragraphs(part.strip(), limit, overlap))]
    return out


def file_chunks(text: str, name: str, kind: str, limit: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """Chunks of a case file by its kind."""
    if not text.strip():
        return []
    if kind == "pdf":
        return page_chunks(text, name, limit, overlap)
    if kind in ("xlsx", "csv", "tsv"):
        return sheet_chunks(text, name, limit, overlap)
    if kind in ("eml", "mbox", "msg"):
        return message_chunks(text, name, limit=limit, overlap=overlap)
    return [(c, name) for c in ([text] if size_of(text) <= limit else by_paragraphs(text, limit, overlap))]
