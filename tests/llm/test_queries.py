"""The registered queries against their SQL on the smallest tables, and the pipeline against plain Python."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import mixing, packing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    rows = sorted(map(str, found.select(sorted(found.columns)).collect()))
    assert rows
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark"):
            duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
        expected = duck.execute(f"select {', '.join(sorted(found.columns))} from ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in found.select(sorted(found.columns)).collect()))) == sorted(map(str, expected))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage's rows against a plain version of it on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps.append((before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    # What the classifier scores 0.5 or higher.
    scored = quality.classify(steps[0][0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(steps[0][1]) == ids(scored.where("predicted = 1"))
    # The largest id of each folded text.
    best = {}
    for i, t in text(steps[1][0]).items():
        key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, i), i)
    assert ids(steps[1][1]) == sorted(best.values())
    # The least id of what links join.
    sets = {i: shingles(t) for i, t in text(steps[2][0]).items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert ids(steps[2][1]) == sorted(set(group.values()))
    # The words that the plan takes.
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(steps[3][0]).collect() if r.taken}
    got = Counter()
    for r in steps[3][1].collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.n_chars == len(r.text)
    assert got == Counter(plan)
    # Every id of every text in one place.
    from tokenizers import Tokenizer

    model, expected = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in steps[4][0].collect():
        flat = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        expected += Counter((r.doc_id, s, n, zlib.crc32(flat[s : s + n].tobytes())) for s, n in packing.cuts(len(flat)))
    rows = steps[4][1].collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "a b", None, None, None), (1, "a b", None, None, None), (2, "", "en", "x", 0), (3, None, "en", "x", None)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.where(F.col("length") <= 0).count() == 0


def test_pipeline_keeps_null_ids_and_counts_repeated_rows_once(spark):
    """One row of each text after exact dedup; of each row, the mix has the words that the plan takes."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(300))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, text(w), "en", "x", 0) for i, w in ((None, "a"), (None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "c"), (1, "d"), (2, "e"), (None, "e"))]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, schema)
    kept = spark.createDataFrame(stages["exact dedup"](spark, docs, "").collect(), schema)
    assert Counter((r.doc_id, r.text[0]) for r in kept.collect()) == Counter([(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "e")])
    for table in (docs, kept):
        plan, got = Counter(), Counter()
        for r in mixing.mix_plan(table).collect():
            plan[r.doc_id] += r.taken
        for r in stages["mixing sources"](spark, table, "").collect():
            got[r.doc_id] += len(r.text.split())
        assert got == plan and got[None] and got[1]


def test_names_and_oracles():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 14)]
