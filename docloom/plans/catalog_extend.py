"""Queries on validation, reports, refreshes, listings, table functions, scorers and archives; rows are made of the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import cases, chunking, citations, extension, requests, retrieval, rules, shared, store, validation
from docloom.plans.registry import query
from docloom.plans.tables import CHUNKS_SQL, chunks, table
from docloom.sources import contents, files, laws, listings
from docloom.streaming.refresh import Refresh

# --- validation and reports --------------------------------------------------

_VALIDATION_SQL = f"""{CHUNKS_SQL},
src AS (SELECT n_nationkey AS source_id, 'nation-' || n_nationkey AS slug, CASE WHEN n_nationkey % 3 = 0 THEN 'statutory_code' ELSE 'agency' END AS source_type FROM nation),
ch AS (SELECT *, CASE WHEN document_id % 4 = 0 THEN 'Cal. Lab. Code § ' || document_id WHEN document_id % 4 = 1 THEN 'none' WHEN document_id % 4 = 2 THEN '' END AS citation FROM chunks),
dd AS (SELECT CAST(substr(source, 4, 9) AS INT) AS source_id, count(*) AS documents FROM documents GROUP BY 1),
per AS (SELECT source_id, count(*) AS chunks, count(*) FILTER (is_active) AS active, coalesce(min(token_count) FILTER (is_active), 0) AS min_tokens, coalesce(max(token_count) FILTER (is_active), 0) AS max_tokens,
  count(*) FILTER (coalesce(citation, '') <> '') AS citations, count(*) FILTER (content_category = 'statutory_code') AS statutory, count(*) FILTER (citation LIKE 'Cal%') AS well_formed, count(*) FILTER (trim(content, ' \t\r') = '') AS empty FROM ch GROUP BY source_id),
f AS (SELECT source_id, slug, source_type, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(active, 0) AS active, coalesce(min_tokens, 0) AS min_tokens, coalesce(max_tokens, 0) AS max_tokens,
  coalesce(citations, 0) AS citations, coalesce(statutory, 0) AS statutory, coalesce(well_formed, 0) AS well_formed, coalesce(empty, 0) AS empty FROM src LEFT JOIN dd USING (source_id) LEFT JOIN per USING (source_id)),
dup AS (SELECT count(*) AS n FROM (SELECT content_hash FROM ch WHERE is_active GROUP BY content_hash HAVING count(DISTINCT source_id) > 1)),
c AS (SELECT slug || '_has_content' AS name, documents > 0 AS passed, documents || ' documents, ' || chunks || ' chunks' AS message FROM f
  UNION ALL SELECT slug || '_has_citations', citations > 0, citations || '/' || chunks || ' chunks have citations' FROM f WHERE source_type = 'statutory_code'
  UNION ALL SELECT slug || '_correct_category', statutory = chunks, statutory || '/' || chunks || ' chunks are statutory_code' FROM f WHERE source_type = 'statutory_code'
  UNION ALL SELECT slug || '_token_bounds', min_tokens >= 1 AND max_tokens <= 10000, 'Token range: ' || min_tokens || '-' || max_tokens FROM f WHERE chunks > 0
  UNION ALL SELECT 'citation_format_validation', sum(well_formed) = sum(citations), sum(well_formed) || '/' || sum(citations) || ' citations match the expected format' FROM f WHERE source_type = 'statutory_code' HAVING sum(citations) > 0
  UNION ALL SELECT 'no_empty_chunks', sum(empty) = 0, CASE WHEN sum(empty) = 0 THEN 'No empty chunks' ELSE sum(empty) || ' empty chunks found' END FROM f
  UNION ALL SELECT 'cross_source_duplicates', true, n || ' content hashes appear in multiple sources' FROM dup)
"""


def _validated(spark, sf_dir):
    key = F.col("n_nationkey")
    sources = table(spark, sf_dir, "nation").select(key.cast("int").alias("source_id"), F.concat(F.lit("nation-"), key.cast("string")).alias("slug"), F.when(key % 3 == 0, "statutory_code").otherwise("agency").alias("source_type"))
    docs = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("int").alias("source_id"))
    number = F.col("document_id")
    citation = F.when(number % 4 == 0, F.concat(F.lit("Cal. Lab. Code § "), number.cast("string"))).when(number % 4 == 1, "none").when(number % 4 == 2, "")
    rows = chunks(spark, sf_dir).withColumn("citation", citation)
    figures = shared.written(validation.source_figures(sources, docs, rows), "figures")
    duplicates = rows.where("is_active").groupBy("content_hash").agg(F.countDistinct("source_id").alias("n")).where("n > 1")
    return figures, validation.checks(figures, duplicates)


@query("WITH" + " " + _VALIDATION_SQL + "SELECT * FROM c")
def validation_checks(spark, sf_dir):
    """Seven families of checks over all sources."""
    return _validated(spark, sf_dir)[1]


@query("WITH" + " " + _VALIDATION_SQL + """SELECT 0 AS part, '0' AS place, '# Validation report' AS line
UNION ALL SELECT 0, '1', '**Status:** ' || CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 0, '2', '**Checks:** ' || count(*) FILTER (passed) || '/' || count(*) || ' passed' FROM c
UNION ALL SELECT 1, slug, '| ' || concat_ws(' | ', slug, source_type, documents, chunks, active, citations) || ' |' FROM f
UNION ALL SELECT 2, name, '- **[' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ']** `' || name || '`: ' || message FROM c""")
def validation_report(spark, sf_dir):
    """The report in Markdown, written as text and read again."""
    figures, found = _validated(spark, sf_dir)
    lines = validation.report_lines(figures, found)
    path = shared.temporary(spark, "report")
    lines.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(lines.schema).csv(path)


@query("""SELECT o_custkey AS slug, '{"o_custkey":' || o_custkey || ',"n":' || count(*) || ',"late":' || count(*) FILTER (o_orderstatus = 'F') || '}' AS json FROM orders GROUP BY o_custkey""")
def report_json(spark, sf_dir):
    """Figures as JSON, written and read again line by line."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("late"))
    told = rows.select(F.col("o_custkey").alias("slug"), F.to_json(F.struct("o_custkey", "n", "late")).alias("json"))
    path = shared.temporary(spark, "json")
    told.write.json(path)
    return spark.read.schema(told.schema).json(path)


@query("""SELECT l_returnflag AS mode, count(*) AS n, round(avg(l_linenumber - 1), 6) AS avg_results, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey % 3 = 0)::INT END), 6) AS disclaimer_rate,
round(avg(CASE WHEN l_partkey % 5 > 0 THEN l_quantity END), 6) AS avg_level, round(avg(CASE WHEN l_linenumber % 3 > 0 THEN l_discount END), 6) AS avg_accuracy, round(avg(CASE WHEN l_linenumber % 4 > 0 THEN l_discount END), 6) AS avg_completeness,
round(sum(l_partkey % 7)::DOUBLE, 6) AS total_cost, count(*) FILTER (l_linenumber = 1) AS without_results FROM lineitem GROUP BY l_returnflag""")
def answer_evaluation(spark, sf_dir):
    number, discount = F.col("l_linenumber"), F.col("l_discount")
    answers = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"), (number - 1).alias("n_results"), F.when(number % 2 == 0, F.col("l_suppkey") % 3 == 0).alias("disclaimer"), F.col("l_quantity").alias("level"), (F.col("l_partkey") % 5).alias("length"),
        F.when(number % 3 > 0, discount).alias("accuracy"), F.when(number % 4 > 0, discount).alias("completeness"), (F.col("l_partkey") % 7).cast("double").alias("cost"),
    )
    return validation.answer_evaluation(answers)


@query("""WITH q AS (SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'), v AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS rating FROM lineitem JOIN q ON l_orderkey = k)
SELECT count(*) AS total_feedback, count(*) FILTER (rating = 1) AS thumbs_up, count(*) FILTER (rating = -1) AS thumbs_down, (SELECT count(*) FROM q) AS total_queries,
round(count(*) FILTER (rating = 1)::DOUBLE / count(*), 3) AS approval_rate, round(count(*)::DOUBLE / (SELECT count(*) FROM q), 3) AS feedback_rate FROM v""")
def feedback_by_question(spark, sf_dir):
    """Feedback joined to the log of questions; it counts by the question's time."""
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("created_at"))
    rating = F.when(F.col("l_linenumber") % 3 == 0, 1).when(F.col("l_linenumber") % 3 == 1, -1).otherwise(0)
    feedback = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), rating.alias("rating"))
    return validation.feedback_summary(feedback, log, F.lit("1995-01-01").cast("timestamp"))


# --- refresh, listings, hooks ------------------------------------------------


@query("""WITH d AS (SELECT 'u' || doc_id AS source_url, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id || chr(10) || ' ' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id IS NOT NULL)
SELECT source_url, sha256(text) AS content_hash, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')) AS n_chunks, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')) AS n_embedded FROM d""")
def refreshed_documents(spark, sf_dir):
    """Documents, active chunks and vectors after two batches, the second run twice: a third of the documents changed."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("source_url"), "text", "doc_id", F.lit(1).alias("at"))
    refresh = Refresh(shared.temporary(spark, "refresh"), lambda rows: rows.withColumn("vector", F.array(F.length("content").cast("float"))))
    refresh.apply(docs, 0)
    changed = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new "), F.col("doc_id").cast("string"), F.lit("\n ")))
    for _ in range(2):
        refresh.apply(changed.unionByName(docs.where("doc_id % 3 = 1")), 1)
    counts = lambda name, rows: rows.groupBy("source_url").agg(F.count(F.lit(1)).alias(name))
    found = refresh.table(spark, "documents").select("source_url", "content_hash").join(counts("n_chunks", refresh.table(spark, "chunks").where("is_active")), "source_url", "left")
    return found.join(counts("n_embedded", refresh.table(spark, "embedded")), "source_url", "left").fillna(0)


@query("SELECT (o_orderkey // 500)::INT AS page, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def listed_pages(spark, sf_dir):
    """Pages of 500 orders, written as JSON files of a listing and read through the data source."""
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).cast("int").alias("page"), F.struct("o_orderkey", "o_custkey").alias("item"))
    path = shared.temporary(spark, "listing")
    bodies = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list("item").alias("results"))).alias("body"))

    def write(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            system.create_dir(folder, recursive=True)
            for page, body in zip(batch["page"], batch["body"]):
                with system.open_output_stream(f"{folder}/page-{page}.json") as out:
                    out.write(body.encode())
            yield batch[["page"]]

    bodies.mapInPandas(write, "page int").write.format("noop").mode("overwrite").save()
    listings.register(spark)
    found = spark.read.format("listing").option("path", path).load()
    return found.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("item", "$.o_custkey").cast("long")).alias("total"))


@query("SELECT doc_id, (i - 1)::INT AS ordinal, md5(l) AS piece_hash FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(l, i)")
def lateral_pieces(spark, sf_dir):
    """The lines of all documents by a table function in SQL."""
    extension.register(spark)
    return spark.sql("SELECT d.doc_id, p.ordinal, md5(p.piece) AS piece_hash FROM {docs} d, LATERAL pieces(d.text, 'line') p", docs=table(spark, sf_dir, "documents"))


def length_scorer(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """A stand-in for a model: texts whose length is near a multiple of the question's."""
    return texts.str.len() % (questions.str.len() + 7)


@query("""WITH d AS (SELECT doc_id AS id, doc_id // 10 AS query_id, coalesce(lang, '') AS question, coalesce(text, '') AS content, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, (length(content) % (length(question) + 7))::DOUBLE AS s FROM d),
b AS (SELECT query_id, id, rank, CASE WHEN n <= 1 THEN score ELSE 0.7::DOUBLE * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 - (rank - 1) / n END + (1 - 0.7::DOUBLE) * score END AS blend
  FROM (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY query_id)))
SELECT query_id, id, round(blend, 6) AS blend FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(blend, 9) DESC, rank) <= 3""")
def scored_rerank(spark, sf_dir):
    """Candidates reranked by a scorer of the user's."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).cast("long").alias("query_id"), F.coalesce("lang", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("content"), ((F.col("doc_id") % 10) / 10).alias("score"))
    rows = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return extension.reranked_by(rows, length_scorer, top_k=3).select("query_id", "id", F.round("blend", 6).alias("blend"))


# --- archives, definitions, guides, files ------------------------------------


@query("""SELECT l_orderkey AS k, l_linenumber AS i, CASE l_orderkey % 3 WHEN 0 THEN 'Cal. Lab. Code' WHEN 1 THEN 'Cal. Gov. Code' ELSE 'XYZ' END || ' § ' || l_partkey AS citation, '(a) Pay ' || l_suppkey || chr(10) || '(b) More' AS body, '(a) (b)' AS subdivisions,
CASE WHEN l_suppkey % 3 > 0 THEN 'Division ' || l_suppkey % 3 || ' > ' ELSE '' END || 'Part ' || l_linenumber AS hierarchy, '/faces/codes_displaySection.xhtml?lawCode=' || CASE l_orderkey % 3 WHEN 0 THEN 'LAB' WHEN 1 THEN 'GOV' ELSE 'XYZ' END || '&sectionNum=' || l_partkey AS source_url
FROM lineitem WHERE l_suppkey % 5 <> 0""")
def archive_statutes(spark, sf_dir):
    """Rows of an archive's section table as statutes; those without text are left out."""
    s = lambda c: F.col(c).cast("string")
    law = F.when(F.col("l_orderkey") % 3 == 0, "LAB").when(F.col("l_orderkey") % 3 == 1, "GOV").otherwise("XYZ")
    html = F.when(F.col("l_suppkey") % 5 == 0, "<p> </p>").otherwise(F.concat(F.lit("<p>(a) Pay <i>"), s("l_suppkey"), F.lit("</i></p><p>(b) More</p>")))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), law.alias("law_code"), s("l_partkey").alias("section_num"), html.alias("html"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 3).cast("string")).otherwise("").alias("division"),
        F.lit("").alias("title"), s("l_linenumber").alias("part"), F.lit(None).cast("string").alias("chapter"), F.lit("").alias("article"), F.lit("").alias("history"), F.lit(None).cast("string").alias("effective_date"),
    )
    found = laws.archive_statutes(rows)
    return found.select("k", "i", "citation", F.col("text").alias("body"), F.array_join("subdivisions", " ").alias("subdivisions"), "hierarchy", "source_url")


@query("""SELECT c_custkey, n_nationkey AS ordinal, n_name AS term, n_name || ' means ' || c_name || ' or ' || CASE WHEN c_custkey % 3 = 0 THEN '[EMPLOYER NAME]' ELSE c_mktsegment END AS definition FROM customer CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 4)""")
def case_definitions(spark, sf_dir):
    """The terms of a bank of definitions, with the parties' names of each case in them."""
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("employee"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("employer"))
    bank = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("term"), F.concat("n_name", F.lit(" means {EMPLOYEE} or {EMPLOYER}")).alias("template"))
    return rules.definitions(cases, bank).select("c_custkey", "ordinal", "term", "definition")


@query("""SELECT o_orderkey, n_name AS label, o_custkey % 25 AS type, CASE WHEN o_custkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) THEN (SELECT count(*) FROM supplier WHERE s_nationkey = o_custkey % 25) END AS n_fields
FROM orders LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) ON n_nationkey = o_custkey % 25""")
def incident_guides(spark, sf_dir):
    """The guide of each incident's type, with its fields in order; none where the type has no guide."""
    fields = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("type"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("field"))
    guides = table(spark, sf_dir, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("type"), F.col("n_name").alias("label"))
    incidents = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("type"))
    found = rules.incident_guides(incidents, guides, fields)
    return found.select("o_orderkey", "label", "type", F.size("fields").cast("long").alias("n_fields"))


@query("SELECT l_returnflag AS folder, max('part-' || lpad(l_partkey::VARCHAR, 8, '0') || CASE WHEN l_suppkey % 2 = 0 THEN '.zip' ELSE '.txt' END) FILTER (l_suppkey % 2 = 0) AS newest FROM lineitem GROUP BY l_returnflag")
def newest_archives(spark, sf_dir):
    """Per folder the archive whose name sorts last."""
    name = F.concat(F.lit("part-"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.when(F.col("l_suppkey") % 2 == 0, ".zip").otherwise(".txt"))
    paths = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/"), "l_returnflag", F.lit("/"), name).alias("path"))
    return contents.newest(paths, r"\.zip$").select(F.substring("folder", 2, 10).alias("folder"), "newest")


@query("""SELECT l_orderkey, round(sum(round(l_quantity * l_discount, 2)), 2) AS total, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY l_orderkey""")
def wage_totals(spark, sf_dir):
    """Totals of items that were rounded before they are added."""
    items = table(spark, sf_dir, "lineitem").where("l_discount > 0").select("l_orderkey", rules.money(F.col("l_quantity") * F.col("l_discount")).alias("amount"))
    return rules.item_totals(items, "l_orderkey").withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {CHUNKS_SQL}, t AS (SELECT document_id, chunk_index, token_count, lower(content) AS low FROM chunks),
q AS (SELECT doc_id, coalesce(lang, '') AS lang, source FROM documents)
SELECT document_id, chunk_index, round(least(1.0, h + CASE WHEN h > 0 AND token_count >= 300 THEN 0.1 ELSE 0.0 END), 6) AS score, q.lang, q.source
FROM (SELECT *, (contains(low, 'license')::INT + contains(low, 'copyright')::INT) / 2.0::DOUBLE AS h FROM t) JOIN q ON q.doc_id = document_id WHERE h >= 0.1""")
def keyword_documents(spark, sf_dir):
    """All chunks that a question of two words finds, joined with their documents."""
    rows = chunks(spark, sf_dir).withColumn("heading_path", F.lit(""))
    score = retrieval.keyword_score(F.col("content"), F.col("heading_path"), F.col("token_count"), ["license", "copyright"])
    found = rows.withColumn("score", score).where(F.col("score") >= 0.1)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("lang", F.lit("")).alias("lang"), "source")
    return found.join(docs, "document_id").select("document_id", "chunk_index", F.round("score", 6).alias("score"), "lang", "source")




# --- chunks of each kind -----------------------------------------------------


@query()
def statute_chunks_found(spark, sf_dir):
    """Texts whose lines are subdivisions, packed by them (tests: against plain Python)."""
    lines = F.regexp_replace("text", r"\n(?=\w)", "\n(b) ")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("body"), F.concat(F.lit("Lab. Code § "), F.col("doc_id").cast("string")).alias("citation"))
    return chunking.statute_chunks(rows, "body", "citation", "doc_id", limit=200, overlap=20).select("doc_id", "chunk_index", "heading_path", "token_count", "content_hash")


@query()
def opinion_chunks_found(spark, sf_dir):
    """Texts whose lines are paragraphs, packed with overlap (tests: against plain Python)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"), F.concat(F.lit("In re "), F.col("doc_id").cast("string")).alias("citation"))
    return chunking.opinion_chunks(rows, "body", "citation", "doc_id", limit=200, overlap=20).select("doc_id", "chunk_index", "heading_path", "token_count", "content_hash")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, coalesce(source, '') AS name, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, kind, name, p, i, len(ps) AS n FROM (SELECT *, CASE kind WHEN 1 THEN string_split(text, chr(10)) WHEN 2 THEN string_split(text, chr(10)) ELSE [text] END AS ps FROM d), unnest(ps) WITH ORDINALITY AS t(p, i)),
b AS (SELECT *, regexp_replace(p, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS s FROM p),
c AS (SELECT doc_id, i, CASE WHEN kind = 1 AND n > 1 THEN name || ' > Message ' || i WHEN kind = 2 AND i > 1 THEN name || ' > S' ELSE name END AS heading_path, CASE WHEN kind = 2 AND i > 1 THEN '## S' || CASE WHEN s = '' THEN '' ELSE chr(10) || s END WHEN kind IN (0, 3) THEN p ELSE s END AS content FROM b WHERE s <> '' OR kind = 2 AND i > 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, heading_path, greatest(1, length(content) // 4) AS token_count, sha256(content) AS content_hash FROM c""")
def file_chunks_found(spark, sf_dir):
    """Mail, sheets and plain texts, each kind cut in its own way."""
    kind = F.col("doc_id") % 4
    body = F.when(kind == 1, F.replace("text", F.lit("\n"), F.lit("\n---\n"))).when(kind == 2, F.replace("text", F.lit("\n"), F.lit("\n## S\n"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), "source", F.when(kind == 1, "eml").when(kind == 2, "csv").when(kind == 3, "txt").alias("kind"))
    found = chunking.file_chunks(rows, "body", "source", "kind", "doc_id", limit=1_000_000)
    return found.select("doc_id", "chunk_index", "heading_path", "token_count", "content_hash")


# --- archives read from files, small operators -------------------------------


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CASE l_orderkey % 2 WHEN 0 THEN 'LAB' ELSE 'GOV' END AS law_code, l_partkey::VARCHAR AS section_num, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE '<p>' || l_suppkey || '</p>' END AS html
FROM lineitem WHERE l_linenumber % 3 = 0 AND l_orderkey % 2 = 0 AND l_partkey % 3 = 1""")
def archive_sections(spark, sf_dir):
    """A tab-separated, backtick-quoted section table and its companion texts, written and read: active sections of one code and one division."""
    s = lambda c: F.col(c).cast("string")
    lines = table(spark, sf_dir, "lineitem")
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    cells = [F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")), F.when(F.col("l_orderkey") % 2 == 0, "LAB").otherwise("GOV"), s("l_partkey"), *[F.lit("")] * 5, F.concat((F.col("l_partkey") % 3).cast("string"), F.lit(".")), *[F.lit("")] * 5, F.concat(F.lit("L"), s("l_suppkey")), F.when(F.col("l_linenumber") % 3 == 0, "Y").otherwise("N"), F.lit("u"), F.lit("t")]
    path = shared.temporary(spark, "archive")
    lines.select(F.concat_ws("\t", *map(quoted, cells)).alias("value")).write.text(path)
    lobs = lines.where("l_suppkey % 4 != 0").select(F.concat(F.lit("L"), s("l_suppkey")).alias("lob_file"), F.concat(F.lit("<p>"), s("l_suppkey"), F.lit("</p>")).alias("html")).distinct()
    found = files.filtered_sections(files.law_sections(spark, path, lobs), ["lab"], ["1"])
    return found.select("id", "law_code", "section_num", "html")


@query(r"""SELECT doc_id, CASE WHEN coalesce(h, '') = '' THEN coalesce(text, '') ELSE h || chr(10) || coalesce(text, '') END AS told FROM
(SELECT doc_id, text, concat_ws(' ', CASE WHEN doc_id % 3 = 0 THEN '[Lab. Code § ' || doc_id || ']' END, CASE WHEN doc_id % 2 = 0 THEN source END) AS h FROM documents)""")
def searchable_texts(spark, sf_dir):
    """What is embedded and searched: citation and heading before the text, where there are any."""
    key = F.col("doc_id")
    citation = F.when(key % 3 == 0, F.concat(F.lit("Lab. Code § "), key.cast("string"))).when(key % 3 == 1, "")
    told = store.searchable(F.coalesce("text", F.lit("")), citation, F.when(key % 2 == 0, F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", told.alias("told"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('a' || chr(7) || coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {3,}', '  ', 'g'), ' ') AS told FROM documents WHERE nfc_normalize(coalesce(text, '')) = coalesce(text, '')""")
def sanitized_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a\u0007"), F.coalesce("text", F.lit(""))).alias("raw"))
    return rows.select("doc_id", text.sanitized(F.col("raw")).alias("told"))


@query("""SELECT o_orderkey, 'Lab. Code § ' || o_custkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'Civ. Proc. Code §§ ' ELSE 'Gov. Code §' END || o_orderkey || '.5' AS found FROM orders""")
def statute_mentions(spark, sf_dir):
    """The statutes that a text names, in order."""
    s = lambda c: F.col(c).cast("string")
    told = F.concat(F.lit("Under Lab. Code § "), s("o_custkey"), F.lit(" and "), F.when(F.col("o_orderkey") % 2 == 0, "Civ. Proc. Code §§ ").otherwise("Gov. Code §"), s("o_orderkey"), F.lit(".5, not Code § 3; see sec. 4."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.statute_mentions(told), "|").alias("found"))


@query("""SELECT c_custkey, 'The FEHA ' || upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) || ' of the State' AS title FROM customer""")
def titles(spark, sf_dir):
    """Headings in capitals as titles: acronyms stay, small words are small."""
    raw = F.concat(F.lit("THE feha "), F.upper("c_mktsegment"), F.lit(" OF THE STATE"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.title_case(raw, ("FEHA",), ("of", "the")).alias("title"))


@query("SELECT o_orderkey AS query_id, o_custkey AS chunk_id, '' AS claim_text, 'u' || o_custkey AS source_url, 'c' || o_custkey AS citation, o_orderstatus AS content_category FROM orders")
def fallback_citations(spark, sf_dir):
    """A citation for every row of a context, for answers that name none."""
    s = F.col("o_custkey").cast("string")
    context = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("chunk_id"), F.concat(F.lit("u"), s).alias("source_url"), F.concat(F.lit("c"), s).alias("citation"), F.col("o_orderstatus").alias("content_category"))
    return citations.context_citations(context).select("query_id", "chunk_id", "claim_text", "source_url", "citation", "content_category")


@query("""SELECT l_orderkey AS chunk_id, l_partkey::VARCHAR AS cited_text, min(l_linenumber) AS position FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 = 0 AND l_partkey % 2 = 0) GROUP BY 1, 2""")
def inserted_links(spark, sf_dir):
    """Links that are inserted: the first of each chunk and cited text that is not there."""
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("cited_text"), F.col("l_linenumber").alias("position"))
    there = new.where("chunk_id % 3 = 0 and cast(cited_text as long) % 2 = 0").distinct()
    return store.inserted(there, new, ["chunk_id", "cited_text"], "position").select("chunk_id", "cited_text", "position")


# --- banks, grounds, lists ---------------------------------------------------


@query("""WITH f AS (SELECT s_suppkey::VARCHAR AS section, CASE s_suppkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'employer' ELSE 'employee' END AS d FROM supplier),
c AS (SELECT o_orderkey AS k, o_custkey % 2 = 0 AS p, o_custkey % 5 = 0 AS r FROM orders),
s AS (SELECT k, p, l_suppkey::VARCHAR AS section FROM c JOIN lineitem ON l_orderkey = k),
a AS (SELECT k, section FROM s JOIN f USING (section) WHERE d = 'both' OR d = CASE WHEN p THEN 'employer' ELSE 'employee' END UNION SELECT k, unnest(['200.1', '216.1']) FROM c UNION SELECT k, '217.1' FROM c WHERE r)
SELECT k, string_agg(DISTINCT section, ' ' ORDER BY section) AS sections FROM a GROUP BY k""")
def directed_sections(spark, sf_dir):
    """The sections of a form that each side may ask of the other."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("sections"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 2 == 0).alias("plaintiff"), (F.col("o_custkey") % 5 == 0).alias("has_requests"))
    key = F.col("s_suppkey")
    form = table(spark, sf_dir, "supplier").select(key.cast("string").alias("section"), F.when(key % 3 == 0, "both").when(key % 3 == 1, "employer").otherwise("employee").alias("directed_to"))
    found = cases.directed_sections(orders.join(rows, orders["k"] == rows["l_orderkey"], "left").drop("l_orderkey"), form, "k")
    return found.select("k", F.array_join("sections", " ").alias("sections"))


@query("""SELECT c_custkey, c_mktsegment AS category, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS rank, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')""")
def bank_in_category(spark, sf_dir):
    bank = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    return requests.in_category(bank, ["MACHINERY", "BUILDING", "MACHINERY"], "c_custkey")


@query("SELECT o_orderkey, o_custkey AS ground_id, c_name AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) ON c_custkey = o_custkey")
def ground_lookup(spark, sf_dir):
    grounds = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("ground_id"), F.col("c_name").alias("label"))
    return requests.ground(grounds, table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ground_id"))).select("o_orderkey", "ground_id", "label")


@query("SELECT c_mktsegment AS category, count(*) AS n, string_agg(c_custkey::VARCHAR, ' ' ORDER BY c_custkey) AS keys FROM customer GROUP BY c_mktsegment")
def ground_index(spark, sf_dir):
    found = requests.ground_index(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ground_id"), F.col("c_mktsegment").alias("category")))
    return found.select("category", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), " ").alias("keys"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'""")
def newest_cases(spark, sf_dir):
    """The cases of one status, the last changed first."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return cases.listed(rows, "o_custkey", F.desc("o_orderdate"), "o_orderkey", where=F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "place")
