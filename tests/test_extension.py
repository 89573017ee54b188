"""Listings as batch and stream, the table function, scorers, and small operators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import extension, retrieval, rules
from docloom.sources import laws, listings


def put(folder, number, items=(), **more):
    (folder / f"page-{number}.json").write_text(json.dumps({"results": [{"v": x} for x in items], **more}))


def test_listing_as_batch_and_as_a_stream_that_goes_on(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    listings.register(spark)
    for n in range(7):
        put(folder, n, [n * 10 + i for i in range(n)])
    (folder / "other.txt").write_text("x")
    got = []

    def run():
        stream = spark.readStream.format("listing").option("path", str(folder)).option("pagesAPartition", 2).load()
        query = stream.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    first = len(got)
    put(folder, 7, [70, 71])
    put(folder, 8, retry_after=30)
    run()
    batch = spark.read.format("listing").option("path", str(folder)).load()
    key = lambda r: (r.page, r.ordinal, r.item, r.retry_after)
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, batch.collect())))
    assert first == 21 and len(got) == 24
    assert batch.where("page = 8").collect()[0].retry_after == 30.0
    assert spark.read.format("listing").option("path", str(tmp_path / "none")).load().count() == 0


def test_pages_that_were_put_off(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), 30.0), (1, at(9), None), (2, at(0), None), (2, at(5), 20.0), (3, at(1), 10.0), (3, at(2), 15.0)]
    found = listings.put_off(spark.createDataFrame(rows, "page int, tried_at timestamp, retry_after double"))
    assert sorted((r.page, r.due) for r in found.collect()) == [(2, at(25)), (3, at(17))]


def test_table_function(spark):
    extension.register(spark)
    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "x\n\ny\nz\n\n \n\n")], "id long, body string").createOrReplaceTempView("bodies")
    words = spark.sql("SELECT id, p.* FROM bodies, LATERAL pieces(body, 'words', 2) p").collect()
    assert [(r.id, r.ordinal, r.piece, r.n_words) for r in words if r.id == 1] == [(1, 0, "a b", 2), (1, 1, "c d", 2), (1, 2, "e", 1)]
    assert [(r.ordinal, r.piece, r.n_lines) for r in spark.sql("SELECT p.* FROM bodies, LATERAL pieces(body, 'paragraph') p WHERE id = 3").collect()] == [(0, "x", 1), (1, "y\nz", 2)]
    assert spark.sql("SELECT p.* FROM bodies, LATERAL pieces(body, 'line') p").columns == ["ordinal", "piece"]
    with pytest.raises(Exception, match="way must be one of"):
        spark.sql("SELECT p.* FROM bodies, LATERAL pieces(body, 'page') p").collect()


def test_scorer(spark):
    rows = spark.createDataFrame([(1, 0.5, 1, "q", "aaaa"), (1, 0.4, 2, "q", "a"), (1, 0.3, 3, "q", None), (2, 0.9, 1, "q", "bb")], "query_id long, score double, rank int, question string, content string")
    by_length = lambda q, t: t.str.len()
    got = extension.scored(rows, by_length).orderBy("query_id", "rank").collect()
    assert [r.rerank_score for r in got] == [4.0, 1.0, 0.0, 2.0]
    again = extension.reranked_by(rows, by_length, 0.7, 2).collect()
    assert sorted((r.query_id, r["rank"], round(r.blend, 6)) for r in again) == sorted((r.query_id, r["rank"], round(r.blend, 6)) for r in retrieval.reranked(extension.scored(rows, by_length), 0.7, 2).collect())


def test_small_operators(spark):
    text = spark.range(1).select(laws.html_text(F.lit("<h1>T</h1>\n<p>(a) One <b>two</b>&nbsp;&amp; x<br/>y</p><script>no()</script>")).alias("t")).first().t
    assert text == "T\n(a) One two & x\ny"
    cases = spark.createDataFrame([(1, "Ann", None), (2, " ", "Co")], "k long, employee string, employer string")
    bank = spark.createDataFrame([(1, "YOU", "{EMPLOYER} and {EMPLOYEE}"), (0, "PERSON", "anyone")], "ordinal int, term string, template string")
    assert [(r.k, r.term, r.definition) for r in rules.definitions(cases, bank).orderBy("k", "ordinal").collect()] == [(1, "PERSON", "anyone"), (1, "YOU", "[EMPLOYER NAME] and Ann"), (2, "PERSON", "anyone"), (2, "YOU", "Co and [EMPLOYEE NAME]")]
    guides = spark.createDataFrame([("a", "A"), ("b", "B")], "type string, label string")
    fields = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "type string, ordinal int, field string")
    incidents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, type string")
    got = {r.k: (r.label, r.fields and [f.field for f in r.fields]) for r in rules.incident_guides(incidents, guides, fields).collect()}
    assert got == {1: ("A", ["x", "y"]), 2: ("B", []), 3: (None, None)}
