"""Exact dedup, the Jaccard join, components, paragraph and suffix-array dedup against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import exact_dedup, jaccard_join, paragraphs, suffix_dedup, tokens
from docloom.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCS = "doc_id long, text string"


def fold(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


# --- exact dedup -------------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    return sorted((i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(table, corpus, block):
    """Small blocks make several rounds of naming, with blocks that recur within and across texts."""
    rows = [(r[0], r[1]) for r in corpus if r[1] is None or len(r[1]) < 50_000]
    got = exact_dedup.exact_dedup(table(corpus).where("length(text) < 50000 or text is null"), block_bytes=block)
    assert sorted(map(tuple, got.collect())) == exact_by_hand(rows)


def test_exact_dedup_null_and_repeated_ids(table):
    rows = [(None, "a"), (None, "A"), (5, "b"), (5, "b"), (5, "c"), (2, "b"), (None, "b"), (1, None)]
    got = sorted(map(str, (tuple(r)[:4] for r in exact_dedup.exact_dedup(table(rows, DOCS)).collect())))
    expected = [(None, None, 2, True), (None, None, 2, False), (5, 5, 4, True), (5, 5, 4, False), (5, 5, 1, True), (2, 5, 4, False), (None, 5, 4, False), (1, 1, 1, True)]
    assert got == sorted(map(str, expected))


def test_drop_exact_copies(table, corpus):
    docs = table(corpus)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in exact_by_hand([(r[0], r[1]) for r in corpus]) if r[3]]


# --- components --------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(5, i) for i in range(6, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == joined(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- the Jaccard join --------------------------------------------------------


def near_by_hand(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = joined(range(len(rows)), links)
    least = defaultdict(lambda: 1 << 62)
    for n, r in root.items():
        least[r] = min(least[r], rows[n][0])
    return sorted((rows[n][0], len(sets[n]), least[r]) for n, r in root.items())


@pytest.mark.parametrize("percent", [80, 50])
def test_jaccard_join(table, corpus, percent):
    rows = [(r[0], r[1]) for r in corpus]
    got = jaccard_join.near_duplicates(table(corpus), percent=percent)
    assert sorted(map(tuple, got.collect())) == near_by_hand(rows, percent)


def test_jaccard_join_random_edits(table):
    """Many texts around the threshold, in chains where leaders and pairwise rounds both count."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=50)
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(50)] = rng.choice(words)
            base = text if rng.random() < 0.4 else base
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    assert sorted(map(tuple, jaccard_join.near_duplicates(table(rows, DOCS)).collect())) == near_by_hand(rows)


def test_jaccard_join_edges(table):
    none = table([], DOCS)
    assert jaccard_join.near_duplicates(none).count() == 0
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (4, "A"), (None, "a"), (None, "q r s t u v")]
    got = sorted(map(str, map(tuple, jaccard_join.near_duplicates(table(rows, DOCS)).collect())))
    assert got == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (4, 1, 3), (None, 1, 3), (None, 2, None)]))


def test_keep_one_of_each(table, corpus):
    docs = table(corpus)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in near_by_hand([(r[0], r[1]) for r in corpus])})


# --- paragraphs --------------------------------------------------------------


def pieces(text, **how):
    data = np.frombuffer((text or "").encode(), np.uint8)
    p = paragraphs.paragraphs_of(data, np.array([0, len(data)]), **how)
    return list(zip(p.start.tolist(), p.stop.tolist()))


def paragraphs_by_hand(rows):
    places = [(i, n, a, z, (t or "").encode()[a:z].decode()) for n, (i, t) in enumerate(rows) for a, z in pieces(t)]
    sets = [shingles(p[4]) for p in places]
    links = [(a, b) for a in range(len(places)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root, least, gone, partners = joined(range(len(places)), links), {}, defaultdict(set), defaultdict(set)
    for k, r in root.items():
        least[r] = min(least.get(r, 1 << 62), places[k][0])
    for k, r in root.items():
        i, n, a, z, _ = places[k]
        if i > least[r]:
            gone[n] |= set(range(a, z))
            partners[n].add(least[r])
    out = []
    for n, (i, t) in enumerate(rows):
        data, cut = (t or "").encode(), gone[n]
        runs = sum(1 for x in cut if x - 1 not in cut)
        copy = min([j for j, u in rows if (u or "") == (t or "")])
        found = sorted(partners[n]) if copy == i else [copy] if pieces(t) else []
        out.append((i, len(data), len(cut), runs, found, bytes(x for k, x in enumerate(data) if k not in cut)))
    return sorted(out)


@pytest.fixture(scope="module")
def told():
    """Sentences with passages put into the middle of some, changed a little now and then; copies; odd texts."""
    rng = random.Random(4)
    words = [f"u{i}" for i in range(900)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + rng.choice([".", "!", "?", ".", ".\n"])
    passages = [" ".join(sentence(rng.randint(6, 16)) for _ in range(rng.randint(6, 12))) for _ in range(6)]
    rows = []
    for i in range(70):
        text = " ".join(sentence(rng.randint(1, 25)) for _ in range(rng.randint(0, 12))).split(" ")
        for _ in range(rng.randint(0, 2)):
            said = rng.choice(passages).split(" ")
            if rng.random() < 0.4:
                said[rng.randrange(len(said))] = "changed"
            at = rng.randint(0, len(text))
            text = text[:at] + said + text[at:]
        rows.append((i * 7 % 71, " ".join(text)))
    rows += [(90, None), (91, ""), (92, "\n\n. ."), (93, rows[4][1]), (94, rows[4][1]), (95, "le " * 500), (96, "le " * 700), (97, " ".join(rng.choices(words, k=3000))), (98, "é. " * 60 + passages[0])]
    return rows, passages


def test_paragraphs_are_whole_sentences_of_enough_words(told):
    for _, text in told[0]:
        data = (text or "").encode()
        for a, z in pieces(text):
            assert len(data[a:z].split()) >= 20 and (a == 0 or data[a - 1] in b" \n")
        assert pieces(text, apart=1) == sorted(pieces(text, apart=1)) and set(pieces(text)) <= set(pieces(text, apart=1))


def test_passages_get_equal_paragraphs_wherever_they_stand(told):
    rng = random.Random(9)
    for passage in told[1]:
        a, b = (" ".join(rng.choices(["x", "y", "z", "q"], k=30)) + " " + passage + " and so on and on" for _ in range(2))
        said = [{t.encode()[x:y] for x, y in pieces(t)} for t in (a, b)]
        assert said[0] & said[1]


def test_cut_paragraphs(table, told):
    got = paragraphs.cut_paragraphs(table(told[0], DOCS))
    assert sorted((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in got.collect()) == paragraphs_by_hand(told[0])
    assert paragraphs.cut_paragraphs(table([], DOCS)).count() == 0


def test_cut_paragraphs_null_and_repeated_ids(table, told):
    text = told[1][0]
    got = paragraphs.cut_paragraphs(table([(3, text), (3, text), (None, text + " End."), (None, text), (9, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0, r.partners) for r in got) == [(0, True, [3]), (0, True, [3]), (3, False, []), (3, False, []), (9, False, [])]


def test_remove_paragraphs(table, told):
    docs = table(told[0], DOCS)
    got = paragraphs.remove_paragraphs(docs)
    assert got.columns == docs.columns
    kept = {i: k.decode() for i, *_, k in paragraphs_by_hand(told[0])}
    assert {r.doc_id: r.text or "" for r in got.collect()} == kept


def test_passages_without_marks_get_a_whole_paragraph():
    """Unmarked passages of 51 words and more set into unlike texts, with and without marks, share a paragraph that lies inside."""
    rng = random.Random(12)
    for n in [51] * 60 + [60, 77, 120] * 20:
        passage = " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
        found = []
        for every in (8, 10_000):
            around = [[f"u{rng.randrange(5000)}" + "." * (rng.randrange(every) == 0) for _ in range(rng.randint(5, 60))] for _ in range(2)]
            text = " ".join([*around[0], passage, *around[1]])
            found.append({text[a:z] for a, z in pieces(text)})
        assert any(x in passage for x in found[0] & found[1]), n


def test_runs_of_repeated_lines_are_cut_whole(table):
    """A line of 12 words 50 times, cycles of two and three lines, and one word many times, in two documents each."""
    rng = random.Random(13)
    line = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(12)) + ".\n"
    runs = [line() * 50, (line() + line()) * 30, (line() + line() + line()) * 20, "le " * 300]
    rows = [(10 * d + i, f"{line()}{run}{line()}") for i, run in enumerate(runs) for d in (0, 1)]
    for r in paragraphs.cut_paragraphs(table(rows, DOCS)).collect():
        # The last line of a run is in a paragraph that goes past it, as one of its own would be too short.
        assert r.n_removed == 0 if r.doc_id < 10 else len(r.kept.split()) <= 24 + 20, r


def test_band_recall():
    """Of pairs alike by 0.8, nearly all agree on a band; of pairs alike by 0.1, few."""
    rng, hits = np.random.default_rng(0), {0.8: 0, 0.1: 0}
    for like in hits:
        shared = round(2 * 90 * like / (1 + like))
        for _ in range(300):
            pool = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
            both = np.concatenate([pool[:90], pool[90 - shared : 180 - shared]])
            names = paragraphs.signatures(both, np.array([0, 90]), np.array([90, 180]))
            hits[like] += bool((names[0] == names[1]).any())
    assert hits[0.8] >= 295 and hits[0.1] < 15


# --- suffix arrays -----------------------------------------------------------


@pytest.mark.parametrize("alphabet", [2, 4, 200])
def test_two_stage_sorting_matches_plain_sorting(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 60, 400):
        text = rng.integers(1, 1 + alphabet, n, dtype=np.uint8)
        raw, order = text.tobytes(), suffix_dedup.suffix_order(text, 400)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        small = suffix_dedup.smaller_than_successor(text) if n else []
        assert [bool(s) for s in small] == [raw[i:] < raw[i + 1 :] if i + 1 < n else False for i in range(n)]
        equal = suffix_dedup.common_prefix_at_least(text, order, 12) if n else []
        assert [bool(e) for e in equal] == [len(raw) - max(a, b) >= 12 and raw[a : a + 12] == raw[b : b + 12] for a, b in zip(order, order[1:])]


def repeats_by_hand(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - length + 1):
            key = data[s : s + length]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def test_remove_repeats(table, corpus):
    """Copies, shared passages, runs of one byte, and a text much longer than the others."""
    rows = [(r[0], r[1]) for r in corpus]
    extra = [(2001, "x" * 300), (2002, "ab" * 200), (2003, "x" * 120 + "y"), (2004, "é" * 100), (2005, "zé" * 80), (2006, "é" * 40)]
    docs = table(rows + extra, DOCS)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == repeats_by_hand(rows + extra)


def test_remove_repeats_hot_passage(table):
    """A passage that more documents share than a count of 255 can tell apart."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(i, f"{rng.random()}{passage[rng.randint(0, 60) :]}{rng.random()}") for i in range(400)]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(table(rows, DOCS)).collect())) == repeats_by_hand(rows)


def test_remove_repeats_null_and_repeated_ids(table):
    text = "the same sixty characters of text stand in each of these rows"
    got = suffix_dedup.remove_repeats(table([(3, text), (3, text), (None, text + "!"), (9, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, len(text)), (3, 0), (3, 0), (9, 0)]
    assert suffix_dedup.remove_repeats(table([], DOCS)).count() == 0


# --- words -------------------------------------------------------------------


def test_shingles_of_batches_match_plain_python(corpus):
    import pyarrow as pa

    texts = [r[1] for r in corpus]
    data, offsets = tokens.utf8(pa.array(texts))
    hashes, owner = tokens.distinct(*tokens.shingles(tokens.words(data, offsets)))
    counts = np.bincount(owner, minlength=len(texts))
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    by_hash = defaultdict(set)
    for h, o in zip(hashes.tolist(), owner.tolist()):
        by_hash[h].add(o)
    by_shingle = defaultdict(set)
    for i, t in enumerate(texts):
        for s in shingles(t):
            by_shingle[s].add(i)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, by_shingle.values()))


def test_remove_repeats_of_rows_that_repeat(spark):
    """More rows with one id and text than a 16-bit number counts: none of them takes from the smaller document."""
    passage = "the passage that both of them have, of sixty bytes and a few."
    rows = spark.createDataFrame([(1, passage)], DOCS).unionByName(spark.range(70_000).selectExpr("5L as doc_id", f"'0123456789abc{passage}' as text"))
    got = suffix_dedup.remove_repeats(rows).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in got} == {(1, 0, 1), (5, len(passage), 70_000)}


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """Edited copies of one text, some of them twice, and unlike texts with one common passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base, common = rng.choices(words, k=120), " ".join(rng.choices(words, k=9))
    texts = []
    for _ in range(500):
        edited = list(base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        texts += [" ".join(edited)] * rng.choice([1, 1, 2])
    texts += [f"{common} {' '.join(rng.choices(words, k=12))}" for _ in range(500)]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    expected = joined(range(len(sets)), links)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), expected[i]) for i in range(len(sets)))
