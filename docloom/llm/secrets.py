"""Secret scans: Boolean trigram queries from the rules' patterns over an inverted index of each block, then the patterns on the candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser


class Rule(NamedTuple):
    """Spans of `kind`: leftmost non-overlapping matches of `pattern` of which `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False


#: The base, as given. Fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of other keys.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._-]+:([A-Za-z0-9._-]+)@", 1, 6),
)
RULES = BASE + ADDED

#: A set of strings that one place of a pattern may have is followed up to this size.
MOST_STRINGS = 64
#: Bytes of text that are looked up at a time.
WINDOW = 1 << 22

# --- from a pattern to a query -----------------------------------------------

#: A query is a set of conjunctions, any of which must hold; a conjunction is a set of trigrams that must all occur. {frozenset()} holds everywhere.
EVERYWHERE = frozenset([frozenset()])


def _any(queries: list[frozenset]) -> frozenset:
    every = frozenset().union(*queries)
    return frozenset(a for a in every if not any(b < a for b in every))


def _all(a: frozenset, b: frozenset) -> frozenset:
    return _any([frozenset([x | y]) for x, y in product(a, b)])


def _of_strings(strings: set[bytes]) -> frozenset:
    return _any([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _strings(op, value) -> set[bytes] | None:
    """All strings that a node can match, where they are few."""
    if op is C.LITERAL:
        return {chr(value).encode()}
    if op is C.IN:
        found = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(chr(x).encode())
            elif kind is C.RANGE and x[1] - x[0] < MOST_STRINGS:
                found |= {chr(c).encode() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is C.SUBPATTERN:
        return _strings_of(value[-1])
    if op is C.BRANCH:
        each = [_strings_of(b) for b in value[1]]
        return None if None in each else _few(set().union(*each))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] <= 3:
        one = _strings_of(value[2])
        if one is None:
            return None
        found, power = set(), {b""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                found |= power
            power = {a + b for a in power for b in one}
            if len(power) > MOST_STRINGS:
                return None
        return _few(found)
    return None


def _few(strings: set[bytes]) -> set[bytes] | None:
    return strings if len(strings) <= MOST_STRINGS else None


def _strings_of(nodes) -> set[bytes] | None:
    found = {b""}
    for op, value in nodes:
        more = _strings(op, value)
        found = None if more is None else _few({a + b for a in found for b in more})
        if found is None:
            return None
    return found


def _query(nodes) -> frozenset:
    """What must occur wherever the nodes match one after another."""
    query, strings = EVERYWHERE, {b""}
    for op, value in nodes:
        more = _strings(op, value)
        longer = None if more is None else _few({a + b for a in strings for b in more})
        if longer is not None:
            strings = longer
            continue
        query, strings = _all(query, _of_strings(strings)), more or {b""}
        if more is None:
            if op is C.SUBPATTERN:
                query = _all(query, _query(value[-1]))
            elif op is C.BRANCH:
                query = _all(query, _any([_query(b) for b in value[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                query = _all(query, _query(value[2]))
    return _all(query, _of_strings(strings))


def trigram_query(pattern: str) -> frozenset:
    """Conjunctions of trigrams (bytes, A-Z lower-cased), one of which a text must have to match; EVERYWHERE if none is mandatory."""
    folded = {b: frozenset(t.lower() for t in b) for b in _query(_parser.parse(pattern))}
    return _any([frozenset([t]) for t in folded.values()])


# --- index and scan of a block -----------------------------------------------


class Index:
    """Postings of the wanted trigrams over a block of texts: which texts have each, in ascending order."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.number = {t: k + 1 for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.number.items():
            self.table[int.from_bytes(t, "big")] = k
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: pa.Array) -> dict[bytes, np.ndarray]:
        texts = texts.cast(pa.large_string())
        _, at, data = texts.buffers()
        first = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        flat = np.frombuffer(data or b"", np.uint8)[: first[-1]]
        found = [np.empty(0, np.int64)]
        for low in range(int(first[0]), int(first[-1]), WINDOW):
            part = self.fold[flat[low : low + WINDOW + 2]].astype(np.uint32)
            ids = self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hits = np.flatnonzero(ids)
            text = np.searchsorted(first, hits + low, "right") - 1
            inside = hits + low + 3 <= first[text + 1]
            found.append(np.unique(ids[hits[inside]].astype(np.int64) * len(texts) + text[inside]))
        both = np.unique(np.concatenate(found))
        ids, text = both // max(1, len(texts)), both % max(1, len(texts))
        ends = np.searchsorted(ids, np.arange(len(self.wanted) + 2))
        return {t: text[ends[k] : ends[k + 1]] for t, k in self.number.items()}


def candidates(query: frozenset, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The texts of a block that the query leaves, by intersecting postings, shortest first."""
    found = [reduce(lambda a, b: np.intersect1d(a, b, True), sorted((postings[t] for t in need), key=len)) if need else np.arange(n) for need in query]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def spans_in(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Start and end, in code points, of what the rule finds in a text."""
    return [m.span() for m in _compiled(rule).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if rule.group == 0 and re.fullmatch(r"\[[^]\\]+\]\+", pattern):  # of runs of one class, the short ones need no match
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of kind, start, end; code points, end exclusive) for every row.

    Spans are ordered by start, then by the rule's place in `rules`. Each block of
    rows that a task holds gets an inverted index of the trigrams that the rules'
    queries name; the postings of a rule's trigrams are intersected, and its
    pattern runs on the texts that are left. A rule without a mandatory trigram runs
    on every text. Letters are folded in index and queries, so the index serves
    folded and plain rules alike. Nothing is shuffled. Null and empty texts have no
    spans; repeated rows have theirs each; other columns play no part.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(frozenset().union(*(need for q in queries for need in q)))
    schema = pa.schema([("key", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wanted)
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            postings = index.postings(texts)
            spans: dict[int, list] = {}
            read: dict[int, str] = {}
            for place, (rule, query) in enumerate(zip(rules, queries)):
                for i in candidates(query, postings, n).tolist():
                    if i not in read:
                        read[i] = texts[i].as_py()
                    found = spans_in(read[i], rule)
                    if found:
                        spans.setdefault(i, []).extend((start, place, end) for start, end in found)
            out = [[{"kind": rules[place].kind, "start": start, "end": end} for start, place, end in sorted(spans.get(i, []))] for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, schema.field("spans").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "key long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("key", id_col)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, how many spans each base rule has, the digest of the base spans, and all spans as text."""
    found = scan(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
