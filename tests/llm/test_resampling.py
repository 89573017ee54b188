"""Importance resampling against plain Python, on odd tables too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from docloom.llm import resampling
from docloom.llm.secrets import BASE, RULES, candidates, Index, scan, secret_digests, trigram_query

DOCS = "doc_id long, text string"


def words(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, longest=1, buckets=10000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, longest)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def texts_of(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the"] * 200 + ["Été", "naïve", "x-y", "a_b", "Ünder\x00cut"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 60, 200]))) for _ in range(n)]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10000, 10), (2, 50, 25), (3, 7, 100)])
def test_against_plain_python(table, spark, monkeypatch, longest, buckets, percent):
    monkeypatch.setattr(resampling, "FREQUENT", 20)
    docs = [(i, t) for i, t in enumerate(texts_of(150))] + [(None, "one " * 30), (3, "same " * 40), (3, "same " * 40), (9, None), (10, ""), (11, "...")]
    target = texts_of(8, 5) + [None, ""]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(table(docs, DOCS), aims, longest=longest, buckets=buckets, percent=percent)
    assert Counter(tuple(r) for r in found.collect()) == by_hand(docs, target, longest, buckets, 20, percent)


def test_rows_of_a_long_text(table, spark, monkeypatch):
    """Windows of a text, several rows of counts, and features that stand in several of them."""
    rng = random.Random(1)
    docs = [(1, " ".join(f"v{rng.randrange(5000)}" for _ in range(60_000))), (2, "a" * 300_000), (3, "a b " * 50)]
    monkeypatch.setattr(resampling, "WINDOW", 1000)
    for longest in (1, 3):
        found = Counter()
        for part, _ in resampling.features_of(docs[0][1], longest):
            found += part
        assert {k.decode(): v for k, v in found.items()} == dict(Counter(features(docs[0][1], longest)))
    aims = spark.createDataFrame([("a v1 v2",)], "text string")
    found = resampling.resample(table(docs, DOCS), aims, percent=100)
    assert Counter(tuple(r) for r in found.collect()) == by_hand(docs, ["a v1 v2"], percent=100)


def test_odd_tables(table, spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(table([], DOCS), none).count() == 0
    docs = [(1, "x " * 30), (2, "y " * 30)]
    assert Counter(tuple(r) for r in resampling.resample(table(docs, DOCS), none, percent=50).collect()) == by_hand(docs, [], percent=50)


# --- secrets -----------------------------------------------------------------


def spans_by_hand(text):
    found = []
    for place, rule in enumerate(RULES):
        for m in re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0)).finditer(text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, m.end(), rule.kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def secret_texts(n):
    rng = random.Random(2)
    bits = ["password", "PassWD:", 'secret" = "', "token=", "api_key", "APIKEY :'", "AKIA", "ABCDEFGHIJKLMNOPQRST", "deadbeef" * 3, "0123456789abcdef", "é", "ſecret=abcdefgh", "toKen=", "abcde", "abcdef1", " ", "\n", "=", ":", "ghp_" + "a1" * 20, "xoxb-1234567890-abcdef", "-----BEGIN RSA PRIVATE KEY-----", "https://me:hunter22@host", "eyJabc.eyJdefghijklmnopqrstuvwxyzabcdefghijkl.sig", "AIza" + "x" * 35, "😀"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(n)]


def test_spans_against_the_patterns(table):
    texts = [*secret_texts(400), None, "", "to", "token", "password=token:abcdefgh", "x" * 3_000_000 + "token=abcdefgh"]
    docs = [(i % 390, t) for i, t in enumerate(texts)]
    expected = Counter()
    for i, t in docs:
        spans = spans_by_hand(t)
        base = [s for s in spans if s.split(":")[0] in {r.kind for r in BASE}]
        n = Counter(s.split(":")[0] for s in spans)
        expected[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans))] += 1
    found = secret_digests(table(docs, DOCS)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert {s.split(":")[0] for t in texts for s in spans_by_hand(t)} == {r.kind for r in RULES}
    assert scan(table([], DOCS)).count() == 0


@pytest.mark.parametrize("pattern, expected", [("abcd", [{b"abc", b"bcd"}]), ("(abc|x)yz", [{b"abc", b"bcy", b"cyz"}, {b"xyz"}]), ("ab?cd", [{b"abc", b"bcd"}, {b"acd"}]), ("[0-9]+", [set()]), ("a.*", [set()]), ("(?:abc)+d", [{b"abc"}]), ("AB[cd]", [{b"abc"}, {b"abd"}]), ("abc(?!d)", [{b"abc"}]), ("x{3}", [{b"xxx"}]), ("(abc)*", [set()]), ("[^a]bcd", [{b"bcd"}])])
def test_queries(pattern, expected):
    assert {frozenset(e) for e in expected} == set(trigram_query(pattern))


def test_candidates_lose_no_match():
    """Whatever a pattern matches is among the candidates; other texts mostly are not."""
    import pyarrow as pa

    texts = [t for t in secret_texts(200)] + ["plain words only"] * 50
    for rule in RULES:
        query = trigram_query(rule.pattern)
        index = Index(sorted(frozenset().union(*query)))
        left = set(candidates(query, index.postings(pa.array(texts)), len(texts)).tolist())
        regex = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))
        assert {i for i, t in enumerate(texts) if regex.search(t)} <= left
        assert rule.kind == "hex" or not any(i >= 200 for i in left)
    # A slice of an Arrow array, and windows that cut a trigram.
    some = pa.array(["zzz", "a token", "to", "ken"]).slice(1, 3)
    assert Index([b"tok"]).postings(some)[b"tok"].tolist() == [0]
