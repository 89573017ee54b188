"""Queries on case citations, cases, sessions, fetches and categories; rows are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import cases, citations
from docloom.plans.registry import query
from docloom.plans.tables import table

# --- citations ---------------------------------------------------------------

_CASES_SQL = """l AS (SELECT o_orderkey AS link_id, (o_orderkey % 40)::VARCHAR AS volume, CASE o_orderkey % 3 WHEN 0 THEN 'Cal. 4th' WHEN 1 THEN 'Cal.' ELSE 'U.S.' END AS reporter, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 60)::VARCHAR END AS page FROM orders),
c AS (SELECT p_partkey AS chunk_id, p_partkey % 5 <> 0 AS is_active, CASE WHEN p_partkey % 4 = 0 THEN 'faq' ELSE 'case_law' END AS content_category,
  'In re ' || p_name || ', ' || p_partkey % 130 || CASE p_size % 3 WHEN 0 THEN ' Cal. 4th ' WHEN 1 THEN ' Cal. ' ELSE ' U.S. ' END || p_size * 7 || ' (1999)' AS citation FROM part)"""


def _case_links(spark, sf_dir):
    key = F.col("o_orderkey")
    reporter = F.when(key % 3 == 0, "Cal. 4th").when(key % 3 == 1, "Cal.").otherwise("U.S.")
    return table(spark, sf_dir, "orders").select(key.alias("link_id"), (key % 40).cast("string").alias("volume"), reporter.alias("reporter"), F.when(key % 11 != 0, (F.col("o_custkey") % 60).cast("string")).alias("page"))


def _case_chunks(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    reporter = F.when(size % 3 == 0, " Cal. 4th ").when(size % 3 == 1, " Cal. ").otherwise(" U.S. ")
    cite = F.concat(F.lit("In re "), "p_name", F.lit(", "), (key % 130).cast("string"), reporter, (size * 7).cast("string"), F.lit(" (1999)"))
    return table(spark, sf_dir, "part").select(key.alias("chunk_id"), (key % 5 != 0).alias("is_active"), F.when(key % 4 == 0, "faq").otherwise("case_law").alias("content_category"), cite.alias("citation"))


@query(f"""WITH {_CASES_SQL}, k AS (SELECT DISTINCT volume, reporter, page FROM l WHERE page IS NOT NULL),
m AS (SELECT k.*, min(c.chunk_id) AS target_chunk_id FROM k JOIN c ON c.is_active AND c.content_category = 'case_law' AND contains(c.citation, k.volume || ' ' || k.reporter || ' ' || k.page) GROUP BY ALL)
SELECT l.link_id, l.volume, l.reporter, l.page, m.target_chunk_id FROM l LEFT JOIN m ON l.volume = m.volume AND l.reporter = m.reporter AND l.page = m.page""")
def case_links(spark, sf_dir):
    return citations.resolved_cases(_case_links(spark, sf_dir), _case_chunks(spark, sf_dir))


@query(f"""WITH {_CASES_SQL}, a AS (SELECT *, (1990 + link_id % 3)::VARCHAR AS year FROM l WHERE reporter LIKE 'Cal%' AND page IS NOT NULL),
k AS (SELECT DISTINCT volume, reporter, page FROM a),
r AS (SELECT *, volume::INT % 6 AS kind FROM k WHERE volume::INT % 7 <> 0)
SELECT a.link_id, CASE WHEN r.kind IS NULL OR r.kind IN (0, 3) THEN 'not_found' WHEN r.kind = 1 THEN 'ambiguous' WHEN r.kind = 2 THEN 'error' WHEN r.kind = 4 THEN 'wrong_jurisdiction' WHEN a.year <> '1991' THEN 'date_mismatch' ELSE 'verified' END AS status,
CASE WHEN r.kind IN (4, 5) THEN 'Case ' || a.volume END AS case_name, CASE WHEN r.kind IN (4, 5) THEN '1991' END AS year_filed FROM a LEFT JOIN r ON a.volume = r.volume AND a.reporter = r.reporter AND a.page = r.page""")
def case_verification(spark, sf_dir):
    links = _case_links(spark, sf_dir)
    asked = links.withColumns({"year": (1990 + F.col("link_id") % 3).cast("string"), "is_state": citations.of_state(F.col("reporter"), F.lit(None).cast("string"))})
    kind = F.col("volume").cast("int") % 6
    cluster = F.struct(F.concat(F.lit("Case "), "volume").alias("case_name"), F.lit("1991-02-03").alias("date_filed"))
    known = links.where("page is not null and cast(volume as int) % 7 != 0").select("volume", "reporter", "page").distinct()
    answer = known.withColumns({
        "code": F.when(kind == 0, 404).when(kind == 1, 300).otherwise(200), "error": F.when(kind == 2, "timed out"), "ordinal": F.lit(0),
        "matched": F.when(kind == 4, "1 U.S. 2").otherwise(F.concat_ws(" ", "volume", "reporter", "page")), "clusters": F.when(kind == 3, F.array().cast("array<struct<case_name:string,date_filed:string>>")).otherwise(F.array(cluster)),
    })
    # A later answer to the same question never counts.
    again = answer.withColumns({"ordinal": F.lit(1), "code": F.lit(404)})
    return citations.verified_cases(asked, answer.unionByName(again)).select("link_id", "status", "case_name", "year_filed")


@query("""WITH a AS (SELECT l_orderkey AS q, (l_partkey % 50)::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN '.5' ELSE '' END AS n, l_linenumber FROM lineitem), k AS (SELECT DISTINCT (p_partkey % 30)::VARCHAR || CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END AS n FROM part WHERE p_size < 9)
SELECT q AS query_id, round(avg(CASE WHEN l_linenumber <> 7 AND n IN (SELECT n FROM k) THEN 1 ELSE 0 END), 6) AS share FROM a GROUP BY q""")
def citation_accuracy(spark, sf_dir):
    half = lambda c: F.when(F.col(c) % 2 == 0, ".5").otherwise("")
    section = F.concat(F.lit("Labor Code § "), (F.col("l_partkey") % 50).cast("string"), half("l_linenumber"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") == 7, "the Act").otherwise(section).alias("citation"))
    known = table(spark, sf_dir, "part").where("p_size < 9").select(F.concat(F.lit("Gov. Code § "), (F.col("p_partkey") % 30).cast("string"), half("p_size")).alias("citation"))
    return citations.share_known(cited, known, "query_id").withColumn("share", F.round("share", 6))


@query("""WITH d AS (SELECT l_orderkey AS query_id, l_linenumber AS ordinal, l_suppkey % 4 AS document_index FROM lineitem),
j AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_index // 2 ORDER BY ordinal, document_index) AS n FROM d WHERE document_index < 3)
SELECT query_id, min(ordinal) AS ordinal, query_id * 10 + document_index // 2 AS chunk_id FROM j GROUP BY query_id, document_index // 2""")
def cited_chunks(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("ordinal"), (F.col("l_suppkey") % 4).alias("document_index"))
    context = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    context = context.withColumn("chunk_id", F.col("query_id") * 10 + F.floor(F.col("position") / 2))
    return citations.cited_chunks(cited, context).select("query_id", "ordinal", "chunk_id")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem)
SELECT s AS asked, 'forward' AS direction, t AS other FROM e WHERE s % 100 = 0 UNION ALL SELECT t, 'reverse', s FROM e WHERE t % 100 = 0""")
def citation_neighbours(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("target_chunk_id")).distinct()
    ids = edges.select("chunk_id").unionByName(edges.select(F.col("target_chunk_id").alias("chunk_id")))
    return citations.neighbours(edges, ids.where("chunk_id % 100 = 0"))


# --- cases, sessions, fetches ------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS p, c_custkey % 3 = 0 AS r, c_custkey % 5 = 0 AS e, CASE WHEN c_custkey % 7 <> 0 THEN ['6.1', '16.' || c_custkey % 10 + 1, '20.' || c_custkey % 11 + 1] ELSE [] END AS s FROM customer),
x AS (SELECT c_custkey, p, unnest(s || ['1.1', '15.1'] || CASE WHEN e THEN ['3.1', '3.2', '3.3', '3.4', '3.5', '3.6', '3.7'] ELSE ['2.1'] END || CASE WHEN r THEN ['17.1'] ELSE [] END) AS v FROM c)
SELECT c_custkey, string_agg(DISTINCT v, ' ' ORDER BY v) AS sections FROM x WHERE v NOT LIKE '20.%' AND (p OR v NOT LIKE '16.%') GROUP BY c_custkey""")
def suggested_sections(spark, sf_dir):
    key = F.col("c_custkey")
    of_claims = F.when(key % 7 != 0, F.array(F.lit("6.1"), F.concat(F.lit("16."), (key % 10 + 1).cast("string")), F.concat(F.lit("20."), (key % 11 + 1).cast("string"))))
    found = cases.suggested_sections(of_claims, key % 2 == 0, key % 3 == 0, key % 5 == 0)
    return table(spark, sf_dir, "customer").select(key, F.array_join(found, " ").alias("sections"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'PLAINTIFF ' || upper(c_name) || '''S REQUESTS TO DEFENDANT ' ELSE 'DEFENDANT ' END || CASE WHEN c_custkey % 3 = 0 THEN 'DEFENDANT' ELSE 'ACME ' || c_nationkey END ||
CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '''S REQUESTS TO PLAINTIFF ' || upper(c_name) END || ', Set ' || coalesce(['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten'][c_custkey % 12 + 1], (c_custkey % 12 + 1)::VARCHAR) AS title,
c_name || ',' || chr(10) || 'Bo Li' || CASE WHEN c_custkey % 4 = 0 THEN ';' || chr(10) || 'Does 1 through 50, inclusive' ELSE '' END AS block FROM customer""")
def document_titles(spark, sf_dir):
    key, own = F.col("c_custkey"), F.array(F.col("c_name"), F.lit("Bo Li"))
    other = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Acme "), F.col("c_nationkey").cast("string"))))
    title = cases.document_title(own, other, key % 2 == 0, F.lit("REQUESTS"), key % 12 + 1)
    return table(spark, sf_dir, "customer").select(key, title.alias("title"), cases.party_block(own, key % 4 == 0).alias("block"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 3 = 0 OR conv_id % 4 = 1)")
def unexpired_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "2024-01-01T00:00:00").when(F.col("turn") % 3 == 1, "2026-01-01T00:00:00").alias("expires_at"), (F.col("conv_id") % 4 == 1).alias("is_revoked"))
    return cases.unexpired(rows, F.lit("2025-01-01T00:00:00")).select("conv_id", "turn")


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 24) AS n_failed, count(*) >= 6 AND count(*) FILTER (WHERE l_quantity > 24) > 0.5 * count(*) AS is_broken FROM lineitem GROUP BY l_suppkey")
def fetch_breaker(spark, sf_dir):
    return cases.broken_off(table(spark, sf_dir, "lineitem").withColumn("failed", F.col("l_quantity") > 24), "l_suppkey", "failed")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber % 2 AS page, coalesce(avg(CASE WHEN l_quantity > 10 AND l_returnflag <> 'N' THEN l_quantity - 10 END) / 100, 0) AS c FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(avg(c), 6) AS confidence FROM p GROUP BY l_orderkey""")
def page_confidence(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), F.when(F.col("l_returnflag") == "N", "  ").otherwise("word").alias("word"), (F.col("l_quantity").cast("double") - 10).alias("conf"))
    return cases.page_confidence(words, "l_orderkey", "page", "word", "conf").withColumn("confidence", F.round("confidence", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS opinion_id FROM orders")
def lead_opinions(spark, sf_dir):
    url = lambda key: F.concat(F.lit("https://example.org/opinions/"), key.cast("string"), F.when(F.col("o_orderkey") % 3 == 1, "/").when(F.col("o_orderkey") % 3 == 0, "/x").otherwise(""))
    opinions = F.array(url(F.col("o_custkey")), url(F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", cases.id_of_url(F.try_element_at(opinions, F.lit(1))).alias("opinion_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 < 2 THEN ['faq', 'fact_sheet', 'agency_guidance', 'poster'][doc_id % 4 + 1] ELSE 'regulation' END AS category FROM documents
WHERE CASE WHEN doc_id % 3 = 0 OR doc_id % 4 < 2 THEN true ELSE false END""")
def agency_categories(spark, sf_dir):
    key = F.col("doc_id")
    of_url = F.element_at(F.array(*map(F.lit, ("faq", "fact_sheet", "agency_guidance", "poster"))), (key % 4 + 1).cast("int"))
    category = cases.category_with_default(F.when(key % 3 == 0, "agency_guidance").otherwise("regulation"), of_url)
    return cases.of_tier(table(spark, sf_dir, "documents").select(key, category.alias("category")), "agency", "category")


@query("""SELECT conv_id AS case_id, turn % 3 AS file_id, turn AS chunk_index FROM conversations WHERE conv_id % 2 = 0 AND turn % 3 <> 1""")
def case_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") % 3).alias("file_id"), F.col("turn").alias("chunk_index"), (F.col("conv_id") % 2 == 0).alias("is_active"))
    left = cases.without_files(rows, rows.where("file_id = 1"))
    return cases.chunks_of(left).select("case_id", "file_id", "chunk_index")


@query("""SELECT c_custkey, 'I am a California employee who ' || ['was recently terminated', 'recently quit', 'is still employed'][c_custkey % 3 + 1] || CASE WHEN c_custkey % 2 = 0 THEN ' working for a government employer' ELSE '' END ||
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' . Specifically, two; one' END || '. What are my rights under California law and what steps should I take?' AS question FROM customer""")
def intake_questions(spark, sf_dir):
    key, issue = F.col("c_custkey"), lambda t, c: F.struct(F.lit(t).alias("issue_type"), F.lit(c).alias("confidence"))
    issues = F.when(key % 5 == 0, F.array(issue("other", "high"))).otherwise(F.array(issue("a", "medium"), issue("other", "low"), issue("b", "high")))
    status = F.element_at(F.array(F.lit("terminated"), F.lit("quit"), F.lit("employed")), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(key, cases.intake_query(status, key % 2 == 0, issues, {"a": "one", "b": "two"}).alias("question"))


@query("""SELECT o_orderkey AS chunk_id, CASE WHEN c_custkey % 4 <> 1 THEN 'u' || c_custkey ELSE '' END AS source_url, CASE WHEN c_custkey % 4 <> 1 AND c_custkey % 3 <> 0 THEN 'es' ELSE 'en' END AS language, CASE WHEN c_custkey % 4 <> 1 THEN c_nationkey ELSE 0 END AS source_id
FROM orders JOIN customer ON o_custkey = c_custkey""")
def embedding_metadata(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").where(key % 4 != 1).select(key.alias("id"), F.concat(F.lit("u"), key.cast("string")).alias("source_url"), F.when(key % 3 != 0, "es").alias("language"), F.col("c_nationkey").alias("source_id"))
    return cases.joined_defaults(chunks, docs).drop("document_id")
