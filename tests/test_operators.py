"""Operators on small rows made by hand."""

import datetime as dt
import re
import sys
import time
import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from docloom.functions import fixed, text
import plain_chunks as chunking
from docloom.operators import analytics, cases, citations, graph, requests, retrieval, rules, store
from docloom.sources import files
from docloom.streaming import limits


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_clean_keeps_structure_and_drops_boilerplate(spark):
    said = "Skip to Main Content\n#  A   b\n\n\n\nx —  y…\n| a   b |\n  Menu  \nend"
    assert one(spark, text.cleaned(F.col("t")), t=said) == "#  A   b\n\nx - y...\n| a   b |\n\nend"
    assert one(spark, text.cleaned(F.lit(None).cast("string"))) == ""


def test_urls(spark):
    assert one(spark, text.normalize_url(F.col("u")), u="HTTPS://Ex.COM/Path?q=1#top") == "https://ex.com/Path?q=1"
    assert one(spark, text.url_parameters(F.col("u")), u="http://a/b?x=1&y=2#z") == {"x": "1", "y": "2"}
    assert one(spark, text.scope_of_url(F.col("u"), ["a\\.org"], []), u="http://a.org/F.PDF?x") == "pdf_download"
    assert one(spark, text.language_of_url(F.col("u")), u="http://a/form_spanish.pdf") == "es"


def test_sanitized_and_table(spark):
    assert one(spark, text.sanitized(F.col("t")), t="é\x00  a\n\n\n\nb ") == "é  a\n\nb"
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))
    assert one(spark, text.table_markdown(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_question(spark):
    row = spark.createDataFrame([("  Does Cal. Gov. Code section 12940(a)  apply?!",)], "q string")
    got = row.select(*[c.alias(n) for n, c in text.question_parts(F.col("q")).items()]).first().asDict()
    assert got == {"normalized": "Does Cal. Gov. Code section 12940(a) apply", "has_citation": True, "cited_section": "12940(a)", "cited_code": "Gov. Code"}


def test_chunk_sections_and_paths():
    found = chunking.document_chunks("intro\n# A\n" + "a" * 900 + "\n### C\n" + "c" * 900, least=200, limit=300)
    assert [p for _, p in found] == ["A", "A >  > C"]
    assert found[0][0].startswith("intro\n\n# A")


def test_chunks_split_by_paragraph_sentence_and_window():
    paragraphs = "\n\n".join(f"p{i} " + "x" * 76 for i in range(10))
    got = chunking.by_paragraphs(paragraphs, 50, 20)
    assert all(chunking.size_of(c) <= 50 for c in got) and got[1].startswith(got[0].split("\n\n")[-1])
    assert chunking.windows("y" * 450, 50) == ["y" * 200, "y" * 200, "y" * 50]
    assert chunking.by_sentences("z" * 900, 50, 0) == chunking.windows("z" * 900, 50)


def test_statute_and_opinion_chunks():
    law = "lead\n(a) " + "a" * 300 + "\n(b) " + "b" * 300
    got = chunking.statute_chunks(law, "Lab. Code § 1", 100)
    assert len(got) == 2 and got[1].startswith("[Lab. Code § 1]\n\n(b)")
    assert chunking.statute_chunks(" ", "x") == [] and chunking.statute_chunks("short", "x") == ["short"]
    assert chunking.opinion_chunks("\n\n".join("w" * 200 for _ in range(4)), "T", 100, 10)[1].startswith("[T]\n\n")


def test_pages_sheets_and_messages():
    got = chunking.page_chunks("one\f\ftwo\f" + "x" * 5000, "f.pdf")
    assert got[0] == ("one\n\ntwo", "f.pdf > Pages 1-3") and got[1][1] == "f.pdf > Page 4"
    assert chunking.sheet_chunks("pre\n## S\n| a |", "f.csv") == [("pre", "f.csv"), ("## S\n| a |", "f.csv > S")]
    assert [p for _, p in chunking.message_chunks("a\n---\n \n---\nb", "m")] == ["m > Message 1", "m > Message 3"]


def test_deadlines_keep_month_ends(spark):
    rows = spark.createDataFrame([("cfra_family_leave", dt.date(2024, 2, 29), dt.date(2026, 12, 1)), ("government_employee", dt.date(2024, 8, 31), dt.date(2025, 2, 1))], "claim_type string, incident_date date, as_of date")
    got = {(r.claim_type, r.ordinal): (r.deadline, r.urgency) for r in rules.deadlines(rows, rules.deadline_rules(spark)).collect()}
    assert got["cfra_family_leave", 0] == (dt.date(2027, 2, 28), "urgent")
    assert got["government_employee", 0] == (dt.date(2025, 2, 28), "critical")


def test_wages(spark):
    day = dt.date(2024, 1, 1)
    row = (1, Decimal("20.005"), Decimal("10"), "quit_without_notice", day, dt.date(2024, 1, 4), 0, 2, dt.date(2023, 1, 1), day)
    schema = "k int, hourly_rate decimal(12,4), unpaid_hours decimal(12,4), employment_status string, termination_date date, paid_date date, meal_breaks int, rest_breaks int, unpaid_since date, as_of date"
    got = {r.category: str(r.amount) for r in rules.wage_items(spark.createDataFrame([row], schema), "k").collect()}
    assert got == {"unpaid_wages": "200.05", "rest_break_premium": "40.01", "waiting_time_penalty": "0.00", "interest": "20.01"}


def test_vectors_with_ties_and_no_rows(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.id, r["rank"]) for r in retrieval.nearest(q, v, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert retrieval.nearest(q, v.limit(0), 2).count() == 0


def test_upsert_and_runs(spark):
    schema = "id long, source_url string, content_hash string"
    current = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], schema)
    staged = spark.createDataFrame([(9, "a", "y"), (8, "b", "w"), (7, "c", "v")], schema)
    assert {r.source_url: r.status for r in store.upsert_status(current, staged).collect()} == {"a": "unchanged", "b": "updated", "c": "new"}
    assert sorted(r.id for r in store.upserted(current, staged).collect()) == [1, 2, 7, 8]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    got = {r.query_id: (r.precision_at_k, r.reciprocal_rank, r.hit) for r in analytics.ranking_metrics(rows).collect()}
    assert got == {1: (0.5, 0.5, True), 2: (0.0, 0.0, False)}
    assert one(spark, analytics.recall(F.array(F.lit("§ 12.5")), F.array(F.lit("12"), F.lit("13")))) == 0.5


def test_spacing_and_frontier(spark):
    assert one(spark, graph.spaced(F.array(*map(F.lit, (0, 10, 19, 20, 45))), 20)) == [0, 20, 45]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 2)], "src long, dst long")
    assert {r.node: r.level for r in graph.frontier(links, spark.createDataFrame([(1,)], "node long")).collect()} == {1: 0, 2: 1, 3: 2}


def test_large_levels_of_a_frontier_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_LEVEL", 0)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 2), (8, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,)], "node long")
    assert {tuple(r) for r in graph.frontier(links, seeds).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r) for r in graph.frontier(links, seeds, most_levels=1).collect()} == {(1, 0), (2, 1)}
    plan = graph.reached(links.withColumnRenamed("dst", "node"), seeds, seeds, small=False)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_page_markdown():
    title, body = files.page_markdown("<title> T </title><nav>n</nav><h2>A</h2><p>x <b>y</b> <a href='/z'>z</a></p><ol><li>p<li>q</ol><table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table>")
    assert title == "T" and body == "## A\n\nx **y** [z](/z)\n\n1. p\n2. q\n\n| h | i |\n| --- | --- |\n| 1\\|2 |  |"


def test_files(spark):
    mail = b"From: a@b\nSubject: s\nContent-Type: text/plain\n\nhello"
    rows = spark.createDataFrame([("x/a.CSV", b"a;b\n1;2\n;\n"), ("m.eml", mail), ("b.docx", b"broken"), ("p.zzz", b"")], "path string, content binary")
    got = {r.path: (r.kind, r.text, r.error) for r in files.extracted_files(rows).collect()}
    assert got["x/a.CSV"] == ("csv", "| a | b |\n| --- | --- |\n| 1 | 2 |", None)
    assert got["m.eml"][1] == "From: a@b\nSubject: s\n\nhello"
    assert got["b.docx"][1] is None and "BadZipFile" in got["b.docx"][2] and "no reader" in got["p.zzz"][2]


def test_archive(spark, tmp_path):
    row = ["`1`", "`LAB`", "`200.`", *["NULL"] * 5, "`2.`", *["NULL"] * 5, "`a.lob`", "`Y`", "`u`", "`t`"]
    (tmp_path / "law.dat").write_text("\t".join(row) + "\nshort\trow\n")
    lobs = spark.createDataFrame([("b.lob", "<p>")], "lob_file string, html string")
    got = files.filtered_sections(files.law_sections(spark, str(tmp_path / "law.dat"), lobs), ["lab"], ["2"]).collect()
    assert [(r.id, r.section_num, r.chapter, r.html) for r in got] == [("1", "200.", None, "")]


def test_sliding_window():
    assert limits.admitted([0, 1, 2, 11, 12], [], 10, 2)[0] == [True, True, False, True, True]


def test_rate_limit_stream(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 40)] + [("b", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    query = limits.sliding_window_limit(stream, 30.0, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    until = time.monotonic() + 90
    try:  # timeouts by the clock make batches without data, so neither a trigger nor processAllAvailable ends it
        while spark.table("limited").count() < len(rows) and time.monotonic() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    got = sorted((r.key, r.at.second, r.admitted) for r in spark.table("limited").collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 40, True), ("b", 0, True)]


def test_refresh_stream_and_windows(spark, tmp_path):
    source = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, source_url string, content_hash string").write.parquet(source)
    stream = spark.readStream.schema("id long, source_url string, content_hash string").parquet(source)
    seen = []
    limits.refresh_stream(stream, lambda batch, i: seen.extend(r.source_url for r in batch.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
    events = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, 0, 5)), ("k", dt.datetime(2024, 1, 1, 0, 1, 5))], "key string, at timestamp")
    assert [r.n for r in limits.windowed_counts(events, "at", "1 minute", "1 minute", "key").orderBy("start").collect()] == [1, 1]


def test_best_chunks_are_neither_broadcast_nor_found_by_sorted_structs(spark):
    laws = spark.createDataFrame([(1, False, "Lab. Code § 12"), (2, True, "Lab. Code § 12.5"), (3, True, "Lab. Code § 12"), (4, False, "Lab. Code § 7"), (5, None, "Lab. Code § 8")], "chunk_id long, is_active boolean, citation string")
    found = citations.best_chunk(spark.createDataFrame([("12",), ("7",), ("8",), ("9",)], "section string"), laws)
    assert {tuple(r) for r in found.select("section", "chunk_id", "found_active").collect()} == {("12", 2, True), ("7", 4, False), ("8", 5, False), ("9", None, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortAggregate" not in plan


def test_patterns_are_searched_only_where_a_word_is(spark):
    said = ["SKIP to main content x", "Skip\u00a0to Content y", "a\n Search \nb", "a\nMenu\n\x0b\nb", "Close", "close\n", "Sacramento\nz 800-884-1684 q 711 r\ns", "ca 95814 CONTACT.center@calcivilrights.ca.gov Relay Service", "b Cookie Policy c\nd", "a \t b\x0bc  d\n- e  f", " \x1f x \u2003 "]
    rows = spark.createDataFrame(list(enumerate(said)), "i long, t string")
    found = rows.select("i", text.cleaned(F.col("t")).alias("a"), text.cleaned(F.col("t"), [f"(?:{p})" for p in fixed.BOILERPLATE]).alias("b"))
    assert [r.a for r in found.orderBy("i").collect()] == [r.b for r in found.orderBy("i").collect()]
    plan = found.select("a")._jdf.queryExecution().analyzed().toString().lower()
    assert "contains(lower(" in plan and r"^\s+|\s+$" not in plan


def test_only_texts_that_nfc_may_change_go_to_python(spark):
    safe = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", fixed.NFC_SAFE) + "]")
    joined = {chr(int(x, 16)) for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and not d.startswith("<") for x in d.split()[1:]} | set(map(chr, range(0x1161, 0x1200)))
    assert not [c for c in map(chr, range(sys.maxunicode + 1)) if safe.match(c) and (not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c) or c in joined)]
    rows = spark.createDataFrame([("e\u0301 \u212b",), ("caf\u00e9 \u4e2d\U0001f600",), (None,)], "t string")
    found = rows.select(text.sanitized(F.col("t")).alias("x"))
    assert [r.x for r in found.collect()] == ["\u00e9 \u00c5", "caf\u00e9 \u4e2d\U0001f600", None]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_directed_sections_are_grouped_once(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "z"], True, True), (2, ["a", "b"], False, False), (3, None, True, False)], "k long, sections array<string>, plaintiff boolean, has_requests boolean")
    form = spark.createDataFrame([("a", "employer"), ("b", "both"), ("c", "both")], "section string, directed_to string")
    found = cases.directed_sections(rows, form, "k")
    assert {r.k: r.sections for r in found.collect()} == {1: ["200.1", "216.1", "217.1", "a", "b"], 2: ["200.1", "216.1", "b"], 3: ["200.1", "216.1"]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_links_without_other_columns_are_not_sorted(spark):
    rows = spark.createDataFrame([(1, "Lab. Code \u00a7 5, 12 Cal. 4th 3 and Lab. Code \u00a7 5"), (1, "Lab. Code \u00a7 5"), (2, "none")], "chunk_id long, said string")
    found = citations.links(citations.extracted(rows, "said"))
    other = citations.links(citations.extracted(rows.withColumn("more", F.lit(1)), "said")).select(found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, other.collect()), key=str) and found.count() == 2
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_requests_are_parsed_in_one_pass(spark):
    texts = ["SPECIAL INTERROGATORY NO. 1: A\nb\nSPECIAL INTERROGATORY NO. 4: C", "Dear\n7. a word here\n8. another one\n9. the last one", "x\n5. only one\n9. and one more", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = requests.parsed_requests(docs, gap=10)
    got = sorted((r.doc_id, r.ordinal, r.request_number, r.request_text) for r in found.collect())
    assert got == [(0, 1, 1, "A\nb"), (0, 2, 4, "C"), (1, 1, 7, "a word here"), (1, 2, 8, "another one"), (1, 3, 9, "the last one")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("RepartitionByExpression") == 1 and "Join" not in plan
