"""Fingerprints, quality, mixing, archives, packing and URL filters against plain Python, round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import fingerprints, mixing, packing, quality, tokens, urls, warc

DOCS = "doc_id long, text string"
SPACE = "\x20\t\n\x0b\x0c\r"


# --- fingerprints ------------------------------------------------------------


def test_fingerprints(table, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(corpus)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, other, nxt = (fingerprints.sketch(pa.array([t])) for t in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own.strings()[0], other.strings()[0])
        for value, s in ((r.near_edited, other), (r.near_next, nxt)):
            a, b = set(own.one(0).tolist()), set(s.one(0).tolist())
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    same = defaultdict(set)
    for i, text in rows:
        same[(text or "").lower() if (text or "").isascii() else text].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_of_few_rows(table):
    one = fingerprints.fingerprints(table([(4, "abcdef")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert fingerprints.fingerprints(table([], DOCS)).count() == 0
    got = fingerprints.fingerprints(table([(None, "zz"), (1, "ab"), (1, "cd"), (7, None)], DOCS)).collect()
    expected = {(7, ""), (1, "ac"), (1, "cz"), (None, "z")}
    assert {(r.doc_id, r.edited_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in expected}


def test_sketches_estimate_containment_and_merge():
    rng = random.Random(0)
    long = " ".join(str(rng.random()) for _ in range(8000))
    short = " ".join(long.split()[2000:3000])
    a, b = fingerprints.sketch(pa.array([short])), fingerprints.sketch(pa.array([long]))
    assert fingerprints.containment(a.one(0), b.one(0)) == 1.0
    assert fingerprints.containment(b.one(0), a.one(0)) == pytest.approx(996 / 7996, abs=0.03)
    assert fingerprints.merge(a.one(0), b.one(0)).tolist() == b.one(0).tolist()
    n, hashes = fingerprints.parse(a.strings()[0])
    assert n == 996 and hashes.tolist() == a.one(0).tolist()


# --- quality -----------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    marked = [(got[r.doc_id], r.quality) for r in labels.collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g, _ in marked)
    out = [(g.score, q, g.predicted) for g, q in marked if g.held_out]
    good, bad = [s for s, q, _ in out if q == 1], [s for s, q, _ in out if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([p == q for _, q, p in out]) > 0.9


def test_quality_reads_no_held_out_label(table, spark, corpus):
    docs = table(corpus)
    ids = [r[0] for r in corpus]
    schema = "doc_id long, quality int, toxic int"
    labels = [(i, i % 2, 0) for i in ids]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    a, b = (sorted(map(tuple, quality.classify(docs, spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b and all(0 <= r[2] <= 1 for r in a)


def test_quality_without_labels_or_rows(table, spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(table(corpus), none).collect()} == {0.5}
    assert quality.classify(table([], DOCS), none).count() == 0
    one_kind = spark.createDataFrame([(r[0], 1) for r in corpus] + [(None, 0), (5, None)], "doc_id long, quality int")
    assert quality.keep_good(table(corpus), one_kind).columns == table(corpus).columns


def test_compiled_rules_score_as_the_model_does(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    rules = quality.tree_rules(x, y, ["a", "b", "c"])
    z = np.stack([r.holds(x, ["a", "b", "c"]) for r in rules], axis=1).astype(float)
    w, b = quality.lasso_logistic(z, y)
    assert (np.abs(w) > 1e-6).sum() < len(w)
    model = quality.RuleModel(tuple(rules), tuple(map(float, w)), float(b))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.s for r in rows.coalesce(1).select(model.score({c: F.col(c) for c in "abc"}).alias("s")).collect()]
    assert got == pytest.approx(list(1 / (1 + np.exp(-(z @ w + b)))))
    assert np.mean((np.array(got) >= 0.5) == (y == 1)) > 0.97


# --- mixing ------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        shares = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 2 * sizes[s]}
        if not over:
            return {s: float(x) for s, x in (out | shares).items()}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= over
    return {s: float(x) for s, x in out.items()}


def test_mix_plan(table, corpus):
    docs = table(corpus)
    plan = mixing.mix_plan(docs, block_tokens=16, shard_tokens=2000)
    got = {r.doc_id: r for r in plan.collect()}
    sizes = {r[0]: len(words_of(r[1])) for r in corpus}
    by_source, taken = Counter(), Counter()
    for i, text, source, *_ in corpus:
        by_source[source] += sizes[i]
        taken[source] += got[i].taken
    target = targets_by_hand(by_source)
    for i, text, source, *_ in corpus:
        assert got[i].size == sizes[i] and got[i].source_size == by_source[source]
        assert got[i].target == pytest.approx(target[source])
        assert 0 <= got[i].taken <= 2 * sizes[i]
    for s in by_source:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 64)
    again = mixing.mix_plan(docs.repartition(5), block_tokens=16, shard_tokens=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_mix_gives_the_words_that_the_plan_takes(table, corpus):
    docs = table(corpus)
    plan = {r.doc_id: r for r in mixing.mix_plan(docs, block_tokens=16, shard_tokens=2000).collect()}
    mixed = mixing.mix(docs, block_tokens=16, shard_tokens=2000)
    assert mixed.columns == docs.columns
    got, texts = Counter(), {r[0]: r[1] for r in corpus}
    for r in mixed.collect():
        got[r.doc_id] += len(words_of(r.text))
        assert set(words_of(r.text)) <= set(words_of(texts[r.doc_id]))
    assert got == Counter({i: r.taken for i, r in plan.items() if r.taken})


def test_mix_of_nothing_and_of_empty_texts(table):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_plan(table([], schema)).count() == 0
    got = mixing.mix_plan(table([(1, None, "a"), (2, " ", None), (None, "", "a")], schema)).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0)] * 3


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague_gives_the_highest_quotients(seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, rng.random() * 1000, rng.random()]) for _ in range(rng.randint(1, 30))]
    most, seats = [rng.randint(0, 40) for _ in votes], rng.randint(0, 200)
    quotients = sorted(((-v / (2 * k + 1), i) for i, (v, m) in enumerate(zip(votes, most)) for k in range(m) if v > 0))[:seats]
    assert mixing.sainte_lague(votes, seats, most).tolist() == [sum(i == j for _, j in quotients) for i in range(len(votes))]


# --- archives ----------------------------------------------------------------


def pages_by_hand(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            first[data] = max(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to not in (None, i) else "response", to if to not in (None, i) else None))
    return sorted(out)


def test_archives_round_trip(spark, table, tmp_path):
    rng = random.Random(5)
    long = ["".join(rng.choices("abcé\r\n ", k=1500)) for _ in range(3)]
    rows = [(i, rng.choice(["http://a.b/c", None, "http://x y\r\nz"]), rng.choice([*long, "short", "short", None, "", "\r\n\r\n", "a\nb\r\n"])) for i in range(60)]
    rows += [(60, "u", "WARC/1.1\r\n\r\n" * 200), (61, "u", "x" * 999), (62, "u", "x" * 999), (63, "u", "y" * 1000), (64, "u", "y" * 1000), (65, "u", "é" * 300_000)]
    pages = table(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    got = warc.archive_round_trip(pages, path)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, pages_by_hand(rows)))
    records = {r.id: r for r in warc.read_warc(spark, path).collect()}
    for i, _, html in rows:
        if records[i].record_type == "response":
            assert bytes(records[i].payload).decode() == (html or "")
            assert records[i].digest_said == hashlib.sha1((html or "").encode()).hexdigest()
        else:
            assert records[i].payload is None


def test_archives_of_nothing(table, tmp_path):
    got = warc.archive_round_trip(table([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert got.count() == 0


# --- packing -----------------------------------------------------------------


def test_packing(table, corpus):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    expected = {r[0]: np.array(model.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4") for r in corpus}
    rows = packing.packed_digests(table(corpus)).collect()
    at, place = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = expected[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id].append((r.start, r.length))
        place[r.sequence_id].append((r.offset, r.length))
    for spans, full in ((at, {i: len(x) for i, x in expected.items()}), (place, None)):
        for key, pieces in spans.items():
            end = 0
            for start, length in sorted(pieces):
                assert start == end and length > 0
                end += length
            assert end == full[key] if full else end <= 4096
    total = sum(map(len, expected.values()))
    assert set(at) == set(expected) and len(place) <= -(-total // 4096) + 1


def test_packing_edges(table):
    assert packing.packed_digests(table([], DOCS)).count() == 0
    got = packing.packed_digests(table([(1, None), (1, None), (None, "a"), (2, "the cat " * 9000)], DOCS)).collect()
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got) == 1 + 1 + 2 + 18_001


def test_word_by_word_ids_are_those_of_whole_texts(spark, sf):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    model, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["", "a\x85b\u3000c\u00a0d it's 12345 \u2028x", "e\u0301 <|endoftext|> É", "İb.İ, ÀB×c÷d.. a\u0301b i'll-don't ʼs x<|endoftext|>y #1a2²½ ÿß\x1c\x7f. ｆＡ… œuvre—. 12.5%"]
    ids, offsets = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_balances(k):
    rng = np.random.default_rng(k)
    sizes = rng.integers(1, 512, 60)
    at = packing.differencing(sizes, k)
    loads = np.bincount(at, sizes, k)
    assert len(loads) == k and loads.sum() == sizes.sum() and loads.max() - loads.min() <= sizes.max()


def test_differencing_of_five_sizes():
    """8 - 7 and 6 - 5 leave 1 and 1; 4 - 1 leaves 3, and 3 - 1 leaves 2."""
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.differencing(sizes, 2), sizes)) == [14, 16]


def test_windows_never_overflow():
    for sizes in ([4000] * 5, [2049] * 7, [4096], [], [1] * 10, [3000, 2000, 1000] * 9):
        sizes = np.array(sizes, np.int64)
        at = packing.windows(sizes)
        assert len(at) == len(sizes) and (not len(sizes) or np.bincount(at, sizes).max() <= 4096)


# --- URL filters -------------------------------------------------------------


def split_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match("[^?#]*", rest[len(host) :])[0]


def rule_by_hand(host, path):
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def ranks_by_hand(edges, seeds, damping=0.85):
    """Mass of hosts without edges goes back to the seeds; 400 rounds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    if not seeds:
        return {}
    at = {h: i for i, h in enumerate(hosts)}
    step, start = np.zeros((len(hosts), len(hosts))), np.array([seeds.get(h, 0.0) for h in hosts])
    for (a, b), w in edges.items():
        step[at[b], at[a]] += w
    total = step.sum(axis=0)
    step = np.where(total > 0, step / np.maximum(total, 1e-300), start[:, None])
    ranks = start
    for _ in range(400):
        ranks = damping * step @ ranks + (1 - damping) * start
    return dict(zip(hosts, ranks))


LINK = r"""(?i)(?:href|src)=["']((?:[a-z]+:)?//[^"']*)"""


def verdicts_by_hand(rows):
    """(id, host, path, rule, verdict, margin) from the contract: seeds are whatever the rules decide on, fetched or not."""
    edges, seeds = Counter(), {"allow": Counter(), "block": Counter()}

    def judge(host, path, n=1):
        if host and rule_by_hand(host, path)[1]:
            seeds[rule_by_hand(host, path)[1]][host] += n

    every = set()
    for _, u, html in rows:
        host, path = split_by_hand(u)
        judge(host, path)
        every.add(host)
        links = {split_by_hand(t if "://" in t else "http:" + t) for t in re.findall(LINK, html or "")}
        links = {(to, way) for to, way in links if host and to and to != host}
        every |= {to for to, _ in links}
        for to, verdict in {(to, rule_by_hand(to, way)[1]) for to, way in links}:
            edges[host, to] += 1
            if verdict:
                seeds[verdict][to] += 1
    for host in every:
        judge(host, "/")
    masses = {k: {h: n / sum(c.values()) for h, n in c.items()} for k, c in seeds.items()}
    trust = ranks_by_hand(edges, masses["allow"])
    distrust = ranks_by_hand({(b, a): w for (a, b), w in edges.items()}, masses["block"])
    out = []
    for i, u, _ in rows:
        host, path = split_by_hand(u)
        rule, verdict = rule_by_hand(host, path)
        margin = distrust.get(host, 0) - trust.get(host, 0)
        out.append((i, host, path, rule, verdict or ("block" if margin > 1e-9 else "allow"), margin))
    return out


PAGES = "page_id long, url string, html string"


def test_url_verdicts(table):
    rng = random.Random(6)
    hosts = ["net", "a.net", "example.net", "x.example.net", "EXAMPLE.com", "example.com", "b.org", "c.info", "d.info", "e.info", "f.info", "notnet", "Éx.info"]
    url = lambda: f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/a', '/de/b?q=/fr/', '/fr/#x', '?x://y', '#z'])}"
    link = lambda: rng.choice([f'<a href="{url()}">', f"<img SRC='//{rng.choice(hosts)}/i'>", '<a href="/local">'])
    rows = [(i, url(), "".join(link() for _ in range(rng.randint(0, 4)))) for i in range(150)]
    rows = [(i, u, h.replace('href="://', 'href="http://')) for i, u, h in rows]
    rows += [(200, None, None), (201, "", ""), (202, "no scheme.net/", "x"), (203, "a://", None), (204, "http://b.org\n/fr/", ""), (203, "a://", None)]
    expected = verdicts_by_hand(rows)
    assert all(abs(e[5]) > 1e-5 or e[5] == 0 for e in expected if e[3] is None)
    got = urls.url_verdicts(table(rows, PAGES))
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, (e[:5] for e in expected)))
    assert {"allow", "block"} == {e[4] for e in expected if e[3] is None}
    assert urls.url_verdicts(table([], PAGES)).count() == 0


def test_distrust_starts_at_blocked_hosts_that_were_not_fetched(table):
    rows = [(1, "http://c.info/", '<a href="http://evil.net/x">'), (2, "http://d.info/", '<a href="http://c.info/y">'), (3, "http://e.info/", ""), (4, "http://f.info/", '<a href="http://example.com/de/1">')]
    got = {r.page_id: r for r in urls.url_verdicts(table(rows, PAGES)).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block"}
    assert got[1].distrust > got[2].distrust > 0


def test_distrust_reaches_the_end_of_a_long_chain(table):
    rows = [(i, f"http://h{i}.info/", f'<a href="http://{"evil.net" if i == 0 else f"h{i - 1}.info"}/">') for i in range(15)]
    got = {r.page_id: r for r in urls.url_verdicts(table(rows, PAGES)).collect()}
    hand = {e[0]: e for e in verdicts_by_hand(rows)}
    for i, r in got.items():
        assert r.verdict == "block" and r.distrust == pytest.approx(hand[i][5], abs=1e-6)


def test_native_operators_use_no_python(spark, sf):
    """The main path of the operators that must stay in DataFrame functions has no Python step."""
    from docloom.llm import queries

    for name in ("op2_exact_dedup", "op9_url_filters"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# --- files by bytes, rows without ids ---------------------------------------


def test_archive_files_are_bounded_by_bytes(table, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((100, 5), (1000, 2), (1 << 62, 1)))
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "x" * rng.choice([0, 50, 100, 101, 700, 1000, 1001, 30_000]) + str(i % 40)) for i in range(80)] + [(3, "http://h/3", None)]
    pages = table(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), min_bytes=200)
    sizes = []
    for name in (tmp_path / "w").glob("*.gz"):
        kinds = [f["warc-type"] == "response" and int(f["content-length"]) for f, _ in warc.parse_warc(warc._inflated(memoryview(name.read_bytes())))]
        sizes.append(len(kinds))
        assert len(kinds) <= 5 and (len(kinds) == 1 or max(kinds) < 1200)
    assert sum(sizes) == len(rows)
    got = Counter(tuple(r) for r in warc.resolved(warc.read_warc(pages.sparkSession, str(tmp_path / "w"))).collect())
    want = Counter()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), i)
    for i, _, html in rows:
        html = html or ""
        revisit = len(html) >= 200 and best[html] != i
        want[(i, len(html), hashlib.sha1(html.encode()).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None)] += 1
    assert got == want


def test_rows_without_ids_are_spread(table):
    rows = [(None, f"w{i} " * 50, "s") for i in range(400)]
    docs = table(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, shard_tokens=1000)
    assert sum(r.taken for r in plan.collect()) == pytest.approx(400 * 50 * 1.5, rel=0.05)  # blocks of 64 words in shards of 1000
    salted = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(17)).bitwiseXOR(F.xxhash64("text")), F.lit(20)).alias("shard")).groupBy("shard").count()
    assert salted.count() == 20


def test_hashes_of_long_data_are_those_of_short_data(monkeypatch):
    """Windows and pieces of long texts give the same words and sketches, with tables of a step's size."""
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "Cd" * 40, "é", "x" * 3000]) * rng.randint(1, 3) for _ in range(3000)) + " " + "Long" * 20_000
    data, offsets = tokens.utf8(pa.array([text, "second text"]))
    whole = tokens.words(data, offsets)
    monkeypatch.setattr(tokens, "STEP_BYTES", 4096)
    monkeypatch.setattr(tokens, "_CACHE", {})
    cut = tokens.words(data, offsets)
    assert (whole.hashes == cut.hashes).all() and (whole.starts == cut.starts).all()
    assert len(tokens._CACHE["up"]) <= 4097
    starts = np.array([0, 5, 5, 9000, 20_000])
    ends = np.array([10_000, 9, 30_000, 9001, 90_000])
    monkeypatch.setattr(tokens, "STEP_BYTES", 4 << 20)
    plain = tokens.spans(data, starts, ends, True)
    monkeypatch.setattr(tokens, "STEP_BYTES", 4096)
    assert (plain == tokens.spans(data, starts, ends, True)).all()


def test_memory_of_a_very_long_text():
    """Hashing 40 MB keeps to a few times the text."""
    import tracemalloc

    text = pa.array(["lorem ipsum dolor " * 2_300_000])
    data, offsets = tokens.utf8(text)
    tokens._tables(tokens.STEP_BYTES + 1)
    tracemalloc.start()
    tokens.words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)


def test_packing_tokenizes_little_text_at_once():
    """A step makes some twenty arrays of its text; the pieces don't depend on its size."""
    import pyarrow as pa

    from docloom.llm import packing, tokens

    n = 2 * packing.STEP_BYTES // 1000
    texts = pa.array([f"word{i} " * (1000 // len(f"word{i} ")) for i in range(n)])
    taken = [sum(len(t.as_py()) for t in texts.slice(a, b - a)) for a, b in tokens.steps(texts, packing.STEP_BYTES)]
    assert len(taken) >= 2 and max(taken) <= packing.STEP_BYTES <= tokens.STEP_BYTES // 8
