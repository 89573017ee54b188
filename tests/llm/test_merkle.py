"""The Merkle manifest against plain Python, folded proofs, tampering, and odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import merkle
from docloom.llm.ranks import placed
from pyspark.sql import functions as F

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and per node its siblings as (before, after) lists, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = i - i % 16
            p.append((level[run:i], level[i + 1 : run + 16]))
        at = [i // 16 for i in at]
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, found = [], []
    for s in order:
        members = sorted(groups[s], key=lambda m: m[:3])
        sub, paths = tree([m[2] for m in members])
        subs.append(sub)
        found.append((members, paths))
    if not subs:
        return Counter()
    root, upper = tree(subs)
    out = Counter()
    for (members, paths), sub, top in zip(found, subs, upper):
        for (_, _, own, r), path in zip(members, paths):
            whole = path + top
            proof = H(*(h for a, b in whole for h in a + b))
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r[:4] + (None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4]),))
            for a, b in whole:
                node = H(*a, node, *b)
            out[(r[0], own, sub, root, proof, node, node == root)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def make(n, sources, seed=0):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "ABC É", "plain", "Ab" * rng.randint(1, 50)])
    return [(rng.choice([None, *range(3 * n)]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), text()) for _ in range(n)]


@pytest.mark.parametrize("block_levels", [1, 2, 3])
def test_against_plain_python(table, block_levels):
    rows = make(700, ["hot"] * 12 + ["b", "é", None, "z"]) + [(5, "lone", "en", 1, "One")]
    found = got(merkle.tamper_test(table(rows, COLUMNS), block_levels))
    assert found == by_hand(rows)
    assert {k[6] for k in found} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256], [257], [1, 1], [15, 16, 17, 1]])
def test_edges_of_runs(table, sizes):
    rows = [(i, f"s{k}", "en", 1, f"T{i}") for k, n in enumerate(sizes) for i in range(n)]
    assert got(merkle.tamper_test(table(rows, COLUMNS), 1)) == by_hand(rows)


def test_more_sources_than_a_run(table):
    rows = [(i, f"s{i % 300}", "en", 1, "x") for i in range(330)]
    assert got(merkle.tamper_test(table(rows, COLUMNS), 2)) == by_hand(rows)


def test_odd_tables(table):
    assert merkle.tamper_test(table([], COLUMNS)).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "Same")] * 40 + [(8, "s", "en", 1, "L" * 2_000_000)]
    assert got(merkle.tamper_test(table(rows, COLUMNS), 1)) == by_hand(rows)


def test_proofs_have_all_that_a_check_needs(table):
    """Folding a leaf with its proof by the widths alone gives the root."""
    rows = make(120, ["a", "a", "b"], 3)
    for r in merkle.manifest(table(rows, COLUMNS), ["text"], block_levels=1).collect():
        node, at = r.leaf.hex(), 0
        hashes = [r.proof[i : i + 32].hex() for i in range(0, len(r.proof), 32)]
        for w in r.widths:
            node = H(*hashes[at : at + w.before], node, *hashes[at + w.before : at + w.before + w.after])
            at += w.before + w.after
        assert node == r.root.hex() == r.folded.hex() and at == len(hashes)


def test_places(spark):
    rows = [(g, v) for g in (None, "a", "b") for v in range(50)] + [("hot", v % 7) for v in range(400)]
    found = placed(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], [F.col("v")]).collect()
    seen = defaultdict(list)
    for r in found:
        seen[r.g].append((r.position, r.v, r.total))
    for g, members in seen.items():
        members.sort()
        assert [m[0] for m in members] == list(range(len(members)))
        assert [m[1] for m in members] == sorted(m[1] for m in members) and {m[2] for m in members} == {len(members)}
