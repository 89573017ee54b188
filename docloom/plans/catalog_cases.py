"""Queries on numbered requests, legal sources, audits, dashboards, answers and files; rows are made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import analytics, requests, store
from docloom.plans.registry import query
from docloom.plans.tables import table
from docloom.sources import laws


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- numbered requests -------------------------------------------------------


def _request_texts(spark, sf_dir):
    """A set of requests for each part: with headings, with a response shell, with bare numbers, and with stray numbers."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    kinds = F.array(
        _text("SPECIAL INTERROGATORIES\nPROPOUNDING PARTY: Party ", key, ";\nSET NO. 3\nDEFINITIONS\nThe ACME WORKS means ", name, "\n\nSPECIAL INTERROGATORY NO. 1:\nState ", name, ".\nAnd more.\nINTERROGATORY NO. 2: Why ", key, "?\n"),
        _text("REQUEST FOR PRODUCTION OF DOCUMENTS\nINSTRUCTIONS\nRead this.\nREQUEST FOR PRODUCTION NO. 4: All of ", name, "\nRESPONSE TO REQUEST FOR PRODUCTION NO. 4: None.\nREQUEST NO. 5:\n\nREQUEST NO. 6: The rest of it, please\n"),
        _text("Dear all\n7. State ", name, "\n8. State it again\n9. And again ", key, "\n"),
        _text("Admit that we met\n5. ", name, " was late\n9. was never late\n"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("text"))


@query("""WITH r AS (SELECT p_partkey AS doc_id, p_partkey % 4 AS k, p_partkey::VARCHAR AS key, p_name AS name FROM part)
SELECT doc_id, 1::BIGINT AS ordinal, 1::BIGINT AS request_number, 'State ' || name || '.' || chr(10) || 'And more.' AS request_text, 'interrogatories' AS kind FROM r WHERE k = 0
UNION ALL SELECT doc_id, 2, 2, 'Why ' || key || '?', 'interrogatories' FROM r WHERE k = 0
UNION ALL SELECT doc_id, 1, 4, 'All of ' || name, 'rfps' FROM r WHERE k = 1 UNION ALL SELECT doc_id, 3, 6, 'The rest of it, please', 'rfps' FROM r WHERE k = 1
UNION ALL SELECT doc_id, 1, 7, 'State ' || name, 'interrogatories' FROM r WHERE k = 2 UNION ALL SELECT doc_id, 2, 8, 'State it again', 'interrogatories' FROM r WHERE k = 2 AND length(name) >= 0
UNION ALL SELECT doc_id, 3, 9, 'And again ' || key, 'interrogatories' FROM r WHERE k = 2""")
def parsed_requests(spark, sf_dir):
    return requests.parsed_requests(_request_texts(spark, sf_dir), gap=10)


@query("""SELECT p_partkey AS doc_id, 'definitions' AS section_type, 'The ACME WORKS means ' || p_name AS content, 'ACME WORKS' AS terms FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'instructions', 'Read this.', '' FROM part WHERE p_partkey % 4 = 1""")
def skipped_sections(spark, sf_dir):
    found = requests.skipped_sections(_request_texts(spark, sf_dir))
    return found.select("doc_id", "section_type", "content", F.array_join("defined_terms", ",").alias("terms"))


@query("""SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'interrogatories' WHEN 1 THEN 'rfps' WHEN 3 THEN 'rfas' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'Party ' || p_partkey ELSE '' END AS propounding,
CASE p_partkey % 4 WHEN 0 THEN 3 ELSE 0 END AS set_number, p_partkey % 4 = 1 AS is_shell FROM part""")
def request_facts(spark, sf_dir):
    facts = requests.request_facts(F.col("text"))
    facts["set_number"] = F.coalesce(facts["set_number"], F.lit(0))
    return _request_texts(spark, sf_dir).select("doc_id", *[facts[n].alias(n) for n in ("kind", "propounding", "set_number", "is_shell")])


def _bank(spark, sf_dir):
    roles = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("plaintiff"))).otherwise(F.array(F.lit("plaintiff"), F.lit("defendant")))
    claims = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("claim"), (F.col("c_custkey") % 5).cast("string"))))
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), roles.alias("applicable_roles"), claims.alias("applicable_claims"))


@query("""SELECT c_mktsegment AS category, lower(c_mktsegment) AS label, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) AS place
FROM customer WHERE c_custkey % 2 = 1 AND (c_custkey % 3 = 0 OR c_custkey % 5 IN (1, 4)) GROUP BY c_mktsegment""")
def request_bank(spark, sf_dir):
    bank = requests.for_role_and_claims(_bank(spark, sf_dir), "defendant", ["claim1", "claim4"])
    named = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")).distinct().withColumns({"label": F.lower("category"), "ordinal": F.col("category")})
    return requests.bank_counts(bank, named)


@query("SELECT o_orderkey AS ground_id FROM orders WHERE o_orderkey % 10 = 0 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') > 180")
def stale_grounds(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    grounds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ground_id"), said.alias("last_verified"))
    return requests.stale_grounds(grounds, F.lit("1998-08-01").cast("date")).select("ground_id")


@query("SELECT s_suppkey AS ground_id FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 = 1")
def grounds_for(spark, sf_dir):
    types = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("rfps"), F.lit("rfas"))).otherwise(F.array(F.lit("rfas")))
    grounds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ground_id"), types.alias("applies_to"), F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")).alias("category"))
    return requests.grounds_for(grounds, "rfps", "c1").select("ground_id")


def _analyses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("request_number"), F.col("l_suppkey").alias("ground_id"), F.col("l_returnflag").alias("explanation"))


def _grounds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("ground_id"), F.col("s_name").alias("label"))


@query("""WITH q AS (SELECT o_orderkey AS case_id, n AS request_number FROM orders, (VALUES ('2'), ('1'), ('x')) AS v(n)),
a AS (SELECT l_orderkey AS case_id, l_linenumber::VARCHAR AS request_number, l_suppkey, s_name || ': ' || l_returnflag AS said, s_name, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 20)
SELECT q.case_id, q.request_number, coalesce(string_agg(said, ' ' ORDER BY l_suppkey, s_name, l_returnflag), '') AS objections, CASE q.request_number WHEN 'x' THEN 1 WHEN '1' THEN 2 ELSE 3 END AS place
FROM q LEFT JOIN a USING (case_id, request_number) GROUP BY q.case_id, q.request_number""")
def request_objections(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(F.lit("2"), F.lit("1"), F.lit("x"))).alias("request_number"))
    found = requests.request_objections(asked, _analyses(spark, sf_dir), _grounds(spark, sf_dir))
    return found.select("case_id", "request_number", requests.objection_text(F.col("objections")).alias("objections"), "place")


@query("""WITH e AS (SELECT p_brand AS reporter_key, max_by(p_partkey % 7, p_partkey) AS g FROM part WHERE p_size > 10 GROUP BY p_brand)
SELECT p_partkey AS case_id, p_size % 7 AS ground_id, p_brand AS reporter_key, CASE WHEN g IS NULL THEN 'unverified' WHEN g = p_size % 7 THEN 'verified' ELSE 'other_ground' END AS status FROM part LEFT JOIN e ON e.reporter_key = p_brand""")
def cited_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    bank = part.where("p_size > 10").select((F.col("p_partkey") % 7).alias("ground_id"), F.col("p_partkey").alias("ordinal"), F.array("p_brand").alias("keys"))
    cited = part.select(F.col("p_partkey").alias("case_id"), (F.col("p_size") % 7).cast("long").alias("ground_id"), F.col("p_brand").alias("reporter_key"))
    return requests.cited_keys(bank, cited)


@query("""SELECT o_orderkey AS case_id, count(*) AS n_markers, count(f.n) AS n_filled FROM orders JOIN (VALUES ('1'), ('2'), ('9')) AS m(n) ON true
LEFT JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber::VARCHAR AS n FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber <> 1) f ON f.k = o_orderkey AND f.n = m.n GROUP BY o_orderkey""")
def shell_filled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    markers = orders.select("case_id", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("9"))).alias("request_number"))
    off = orders.where("case_id % 3 = 0").select("case_id", F.lit("1").alias("request_number"), F.lit(False).alias("is_enabled"))
    return requests.shell_filled(markers, _analyses(spark, sf_dir), off)


# --- legal sources -----------------------------------------------------------


@query("""SELECT p_partkey, 1 AS ordinal, p_partkey || '.5' AS section_number, 'Cal. Lab. Code § ' || p_partkey || '.5' AS citation, 'The ' || p_name || '.' || chr(10) || chr(10) || '(a) First' || chr(10) || chr(10) || '(b) Second' AS text, '(a),(b)' AS marks, 'January 1, 2020' AS effective_date FROM part
UNION ALL SELECT p_partkey, 2, p_size::VARCHAR, 'Cal. Lab. Code § ' || p_size, 'Short', '', NULL FROM part""")
def statute_sections(spark, sf_dir):
    html = _text("<h3>PART 1</h3><div id='content_anchor'><h6 style='x'><b>", F.col("p_partkey").cast("string"), ".5.</b></h6><p>The ", F.col("p_name"), ".</p><p>(a) First</p>\n<p>(b) Second</p><i>(Amended by Stats. 2019. Effective January 1, 2020.)</i><h6>Chapter</h6><h6>", F.col("p_size").cast("string"), ".</h6><p>Short</p><h6>77.</h6><p> </p></div>")
    # A heading without a number ends nothing; its words belong to the section before it, so it is taken out first.
    pages = table(spark, sf_dir, "part").select("p_partkey", F.replace(html, F.lit("<h6>Chapter</h6>"), F.lit("")).alias("html"))
    found = laws.page_sections(pages)
    return found.select("p_partkey", "ordinal", "section_number", laws.citation_of(F.lit("LAB"), F.col("section_number")).alias("citation"), "text", F.array_join("subdivisions", ",").alias("marks"), "effective_date")


@query("""SELECT s_suppkey AS book_id, 'CACI No. 2430' AS citation, 'CACI > Wrongful Termination > No. 2430 — Discharge > Instruction Text' AS heading_path, '[Name of party] claims' || chr(10) || s_name AS text FROM supplier
UNION ALL SELECT s_suppkey, 'CACI No. 2430', 'CACI > Wrongful Termination > No. 2430 — Discharge > Directions for Use', 'Give this.' FROM supplier
UNION ALL SELECT s_suppkey, 'CACI No. 2430', 'CACI > Wrongful Termination > No. 2430 — Discharge > Sources and Authority', 'Case A' || chr(10) || chr(10) || 'Secondary Sources' || chr(10) || 'Book B' FROM supplier
UNION ALL SELECT s_suppkey, 'CACI No. 2521A', 'CACI > FEHA Discrimination and Harassment > No. 2521A — Work > Instruction Text', 'Text two' FROM supplier""")
def instruction_sections(spark, sf_dir):
    pages = F.array(
        F.lit("2430. A\n2431. B\n2432. C"),
        _text("2430. Discharge\n[Name of party] claims\n", F.col("s_name"), "\nNew September 2003\nDirections for Use\nGive this.\n1234"),
        F.lit("CACI No. 2430 WRONGFUL\nSources and Authority\nCase A\nSecondary Sources\nBook B\n2431. Reserved for later\n"), F.lit("VF-2400. Form\n2433. not an instruction"), F.lit("2521A. Work\nText two"), F.lit("3000. Other\nText three"),
    )
    books = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"), F.posexplode(pages).alias("page", "text"))
    return laws.instruction_sections(laws.instructions(books))


@query("""SELECT n_nationkey AS book_id, '2' AS number, 'WAGES AND HOURS' AS title, 'All of ' || n_name || chr(10) || '3 small words' AS text FROM nation UNION ALL SELECT n_nationkey, '4', 'MEAL BREAKS', 'Half an hour' FROM nation""")
def manual_chapters(spark, sf_dir):
    pages = F.array(F.lit("Title page\n2 WAGES AND HOURS\n2 - 1"), _text("All of ", F.col("n_name"), "\nJUNE, 2002\n3 small words\n4 MEAL BREAKS"), F.lit("Half an hour\n4 - 1"), F.lit("ADDENDUM\n5 NOT A CHAPTER\nx"), F.lit("6 NOR IS THIS\ny"))
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("book_id"), F.posexplode(pages).alias("page", "text"))
    return laws.chapters(books).select("book_id", "number", "title", "text")


@query("""SELECT c_nationkey::VARCHAR AS section_number, arg_min(c_custkey + 1000, (r_name || ' > ' || n_name || ' > ' || c_name, c_custkey)) AS id, min(r_name || ' > ' || n_name || ' > ' || c_name) AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_nationkey""")
def contents_sections(spark, sf_dir):
    none = F.lit(None).cast("string").alias("section_number")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"), none)
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name"), none)
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("section_number"))
    return laws.toc_sections(regions.unionByName(nations).unionByName(customers)).select("section_number", "id", "path")


@query(r"""SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_hash FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR b <> text GROUP BY conv_id""")
def block_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return laws.block_text(rows, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_hash"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'no text' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS outcome FROM orders) GROUP BY outcome""")
def opinion_outcomes(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, " ").when(kind == 1, "Under Lab. Code § 98 an overtime claim; the meal break was short").when(kind == 2, "Government Code, and overtime").otherwise("overtime and a meal break")
    opinions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), said.alias("text"))
    return laws.relevant_opinions([opinions, opinions.where("cluster_id % 2 = 0")])[1]


@query("SELECT p_partkey, 'Body ' || p_name AS body, 'Gov. Code § 12940,Lab. Code § ' || p_partkey AS cited FROM part")
def opinion_letters(spark, sf_dir):
    letter = _text("Body ", F.col("p_name"), "\n\n  Very truly yours,\nX")
    cites = F.array_distinct(F.regexp_extract_all(_text("Gov. Code § 12940 and Lab. Code § ", F.col("p_partkey").cast("string"), " and Gov. Code § 12940"), F.lit(r"(?:[A-Z][a-z]+\. )+Code § \d+"), F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", laws.without_signature(letter).alias("body"), F.array_join(cites, ",").alias("cited"))


# --- audits, dashboards, answers, files --------------------------------------


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 50) AS n_verified, count(*) FILTER (WHERE value >= 50 AND value < 90) AS n_unverified, count(*) FILTER (WHERE value >= 90) AS n_suspicious,
round(count(*) FILTER (WHERE value < 50) / count(*)::DOUBLE, 3) AS verified_share FROM events GROUP BY event_type""")
def citation_audit(spark, sf_dir):
    status = F.when(F.col("value") < 50, "verified").when(F.col("value") < 90, "unverified").otherwise("suspicious")
    return analytics.audit_stats(table(spark, sf_dir, "events").withColumn("status", status), "status", "event_type")


@query("""SELECT count(*) AS n, round(avg(t), 1) AS avg_turns, count(*) FILTER (WHERE t > 1) AS n_several, count(*) FILTER (WHERE m = 'user') AS n_user, count(*) FILTER (WHERE m = 'assistant') AS n_assistant
FROM (SELECT conv_id, max(turn) + 1 AS t, arg_min(role, turn) AS m FROM conversations GROUP BY conv_id)""")
def session_totals(spark, sf_dir):
    rows = store.sessions(table(spark, sf_dir, "conversations").withColumn("at", F.lit(0)), "conv_id", "turn", "role", "at").withColumn("turn_count", F.col("turn_count") + 1)
    return analytics.session_stats(rows, ["user", "assistant"])


_BOARD_SQL = """s AS (SELECT c_custkey AS source_id, c_mktsegment AS tier FROM customer), d AS (SELECT o_custkey AS source_id, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT user_id AS source_id, event_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status, ts FROM events),
g AS (SELECT source_id, max_by(status, event_id) AS last_status, max(ts) FILTER (WHERE status = 'completed') AS done FROM e GROUP BY 1),
f AS (SELECT e.source_id, count(*) AS failures FROM e JOIN g USING (source_id) WHERE e.status = 'failed' AND e.ts > coalesce(g.done, TIMESTAMP '1970-01-01') GROUP BY 1),
b AS (SELECT source_id, tier, coalesce(n, 0) AS n_documents, last_status, coalesce(failures, 0) AS failures, done, CASE WHEN done IS NULL THEN 'NEVER_RUN' WHEN epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(done) <= 7 * 86400000000 THEN 'FRESH' ELSE 'STALE' END AS status
      FROM s LEFT JOIN d USING (source_id) LEFT JOIN g USING (source_id) LEFT JOIN f USING (source_id))"""


def _board(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("tier"))
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"))
    return analytics.dashboard(sources, documents, runs, F.lit("2024-01-15").cast("timestamp"))


@query(f"WITH {_BOARD_SQL} SELECT source_id, n_documents, last_status, failures, status FROM b")
def source_dashboard(spark, sf_dir):
    return _board(spark, sf_dir).select("source_id", "n_documents", "last_status", "failures", "status")


@query(f"WITH {_BOARD_SQL} SELECT tier, count(*) AS n_sources, sum(n_documents)::BIGINT AS n_documents, count(*) FILTER (WHERE status = 'FRESH') AS n_fresh, count(*) FILTER (WHERE status = 'STALE') AS n_stale, count(*) FILTER (WHERE status = 'NEVER_RUN') AS n_never_run FROM b GROUP BY tier")
def tier_totals(spark, sf_dir):
    return analytics.tier_totals(_board(spark, sf_dir), ["BUILDING", "MACHINERY"]).drop("place")


@query(f"WITH {_BOARD_SQL} SELECT count(*) FILTER (WHERE status <> 'FRESH') AS n_stale, (SELECT source_id FROM b ORDER BY done NULLS FIRST, source_id DESC LIMIT 1) AS oldest FROM b")
def oldest_source(spark, sf_dir):
    return analytics.oldest(_board(spark, sf_dir))


@query("""WITH a AS (SELECT o_orderkey, '**Short Answer:** order ' || o_orderkey || ' has ' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN ' **Next Steps** consult a lawyer about this matter soon' ELSE '' END AS t FROM orders)
SELECT o_orderkey, length(trim(t)) > 50 AS has_answer, 1 + contains(lower(t), 'urgent')::INT AS n_found, 1 - contains(lower(t), 'urgent')::INT AS n_missing, t LIKE '%**Next Steps%' AS has_format, t LIKE '%consult a lawyer%' AS has_phrase,
contains(lower(t), 'urgent')::INT + contains(lower(t), 'matter')::INT >= 1 AS on_topic FROM a""")
def answer_checks(spark, sf_dir):
    answer = _text("**Short Answer:** order ", F.col("o_orderkey").cast("string"), " has ", F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 == 0, " **Next Steps** consult a lawyer about this matter soon").otherwise(""))
    words = lambda *w: F.array(*map(F.lit, w))
    found = analytics.answer_checks(answer, words("Order", "URGENT"), ["Short Answer", "Next Steps"], ["consult a lawyer", "not legal advice"], words("urgent", "Matter", "nothing"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in found.items()])


@query("""WITH r AS (SELECT l_orderkey AS q, l_returnflag = 'R' AS relevant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem),
m AS (SELECT q, CASE q % 2 WHEN 0 THEN 'consumer' ELSE 'attorney' END AS mode, round(count(*) FILTER (WHERE rank <= 3 AND relevant) / nullif(count(*) FILTER (WHERE rank <= 3), 0)::DOUBLE, 6) AS p,
 round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE relevant), 0.0), 6) AS rr, coalesce(bool_or(rank <= 3 AND relevant), false)::INT AS hit FROM r GROUP BY q)
SELECT mode, count(*) AS n, round(avg(p), 4) AS precision, round(avg(rr), 4) AS mrr, round(avg(hit), 4) AS hit_rate, round(avg(p), 6) >= CASE mode WHEN 'consumer' THEN 0.2 ELSE 0.7 END AS passes FROM m GROUP BY mode""")
def retrieval_evaluation(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "R").alias("relevant"), F.row_number().over(w).alias("rank"))
    metrics = analytics.ranking_metrics(rows, 3).withColumn("mode", F.when(F.col("query_id") % 2 == 0, "consumer").otherwise("attorney"))
    found = analytics.evaluation(metrics, "mode", {"consumer": 0.2, "attorney": 0.7})
    return found.withColumns({c: F.round(c, 4) for c in ("precision", "mrr", "hit_rate")})


@query("""WITH f AS (SELECT source, count(*) AS n, avg(n_chars) AS mean, count(*) FILTER (WHERE lang IS NULL) AS unknown FROM documents GROUP BY source)
SELECT source, 'has_documents' AS "check", n > 0 AS passed FROM f UNION ALL SELECT source, 'long_enough', mean >= 500 FROM f UNION ALL SELECT source, 'languages_known', unknown = 0 FROM f""")
def source_checks(spark, sf_dir):
    figures = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.count_if(F.col("lang").isNull()).alias("unknown"))
    return analytics.checks(figures, "source", {"has_documents": F.col("n") > 0, "long_enough": F.col("mean") >= 500, "languages_known": F.col("unknown") == 0})


@query("SELECT o_custkey, n, CAST(floor(n::DOUBLE / max(n) OVER () * 30) AS INT) AS bar FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def activity_bars(spark, sf_dir):
    return analytics.bars(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN 'error' ELSE 'ready' END AS status, CASE WHEN conv_id % 6 <> 0 THEN sha256(trim(text, ' ')) END AS text_hash, CASE WHEN conv_id % 6 = 0 THEN conv_id % 5 = 0 ELSE conv_id % 5 = 0 END AS is_edited FROM conversations""")
def case_file_states(spark, sf_dir):
    bad = F.col("conv_id") % 6 == 0
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~bad, F.col("text")).alias("text"), F.when(bad, "broken").alias("error"), F.when(F.col("conv_id") % 5 == 0, F.lit("edited by hand")).alias("edited_text"))
    return store.file_states(rows).select("conv_id", "turn", "status", "text_hash", "is_edited")


@query("SELECT conv_id, max(turn) + 1 AS next_order FROM conversations GROUP BY conv_id")
def next_upload_order(spark, sf_dir):
    return store.next_order(table(spark, sf_dir, "conversations"), "conv_id", "turn")
