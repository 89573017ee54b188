"""Queries on citation forms, contents pages, regulations, cascades and change logs; rows are made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.operators import cascades, changes, citation_forms, shared
from docloom.operators.cascades import Reference
from docloom.plans.registry import query
from docloom.plans.tables import table
from docloom.sources import contents

# --- citations ---------------------------------------------------------------

# Sentences with citations of every form behind the text of a document; the rows are told from the keys, not from the text.
_SENTENCES_SQL = r"""
k AS (SELECT o_orderkey AS k, o_orderkey % 3 AS kind, regexp_replace('x' || coalesce(text, '') || '; In ', '[ \t\n\x0B\f\r\x{00A0}]+', ' ', 'g') AS head,
  'Party' || o_custkey AS name, (o_orderkey % 90 + 1)::VARCHAR AS vol, (o_custkey + 7)::VARCHAR AS page, (1990 + o_orderkey % 30)::VARCHAR AS year, (o_custkey + 9)::VARCHAR AS pin, (o_orderkey % 500 + 1)::VARCHAR AS sec FROM orders JOIN documents ON doc_id = o_orderkey),
f AS (SELECT *, vol || CASE kind WHEN 0 THEN ' Cal.4th ' WHEN 1 THEN ' U.S. ' ELSE ' Cal. App. 3d ' END AS volrep FROM k),
s AS (SELECT *, name || ' v. State (' || year || ') ' AS s0, volrep || page AS t0, ', ' || pin || ', they held. Later ' AS g1, name || ', supra, at ' || pin AS t1, '. ' AS g2, 'Id. at ' || pin AS t2, '. See ' AS g3, volrep || 'at ' || pin AS t3, '; and ' AS g4, 'Lab. Code § ' || sec AS t4, '. ' AS g5, 'Ibid.' AS t5 FROM f)
"""


def _sentences(spark, sf_dir):
    orders, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    rows = orders.join(docs, orders["o_orderkey"] == docs["doc_id"])
    text = lambda c: c.cast("string")
    k, name = F.col("o_orderkey"), F.concat(F.lit("Party"), text(F.col("o_custkey")))
    rep = F.when(k % 3 == 0, " Cal.4th ").when(k % 3 == 1, " U.S. ").otherwise(" Cal. App. 3d ")
    volume, page, pin = F.concat(text(k % 90 + 1), rep), text(F.col("o_custkey") + 7), text(F.col("o_custkey") + 9)
    told = F.concat(F.lit("x"), F.coalesce("text", F.lit("")), F.lit("; In "), name, F.lit(" v. State ("), text(1990 + k % 30), F.lit(") "), volume, page, F.lit(", "), pin, F.lit(", they held. Later "), name, F.lit(", supra, at "), pin, F.lit(".  Id. at "), pin, F.lit(".\nSee "), volume, F.lit("at "), pin, F.lit("; and Lab. Code § "), text(k % 500 + 1), F.lit(". Ibid."))
    return rows.select(k.alias("key"), told.alias("told"))


@query(
    "WITH" + _SENTENCES_SQL + """,
e AS (SELECT k, kind, year, vol, page, pin, sec, name, unnest([
  {'i': 0, 't': 'case', 'c': t0, 'at': length(head) + length(s0)},
  {'i': 1, 't': 'supra', 'c': t1, 'at': length(head) + length(s0 || t0 || g1)},
  {'i': 2, 't': 'id', 'c': t2, 'at': length(head) + length(s0 || t0 || g1 || t1 || g2)},
  {'i': 3, 't': 'short_case', 'c': t3, 'at': length(head) + length(s0 || t0 || g1 || t1 || g2 || t2 || g3)},
  {'i': 4, 't': 'statute', 'c': t4, 'at': length(head) + length(s0 || t0 || g1 || t1 || g2 || t2 || g3 || t3 || g4)},
  {'i': 5, 't': 'id', 'c': t5, 'at': length(head) + length(s0 || t0 || g1 || t1 || g2 || t2 || g3 || t3 || g4 || t4 || g5)}]) AS x FROM s)
SELECT k AS key, x.i AS position, x.t AS citation_type, x.c AS cited_text, x.at AS span_start, x.at + length(x.c) AS span_end, CASE WHEN x.i IN (0, 3) THEN vol END AS volume,
  CASE WHEN x.i IN (0, 3) THEN CASE kind WHEN 0 THEN 'Cal. 4th' WHEN 1 THEN 'U.S.' ELSE 'Cal. App. 3d' END WHEN x.i = 4 THEN 'Cal. Lab. Code' END AS reporter,
  CASE WHEN x.i = 0 THEN page END AS page, CASE WHEN x.i < 4 THEN pin END AS pin_cite, CASE WHEN x.i = 0 THEN year END AS year, CASE WHEN x.i IN (0, 1) THEN name END AS plaintiff,
  CASE WHEN x.i = 4 THEN sec END AS section, CASE WHEN x.i < 4 THEN 0 ELSE 4 END AS antecedent, x.i >= 4 OR kind <> 1 AS is_state FROM e"""
)
def citation_forms_found(spark, sf_dir):
    """Full and short cases, supra, id. and statutes with their places, fields, and what they go back to."""
    found = citation_forms.grouped(citation_forms.forms(_sentences(spark, sf_dir), "told"), "key")
    return found.select("key", "position", "citation_type", "cited_text", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "volume", "reporter", "page", "pin_cite", "year", "plaintiff", "section", "antecedent", "is_state")


# --- contents pages ----------------------------------------------------------


@query("""WITH p AS (SELECT page_id AS k, unnest(range(4)) AS i, page_id % 5 AS d FROM pages)
SELECT k AS page_id, i * 2 + 1 AS ordinal, 'https://law.example/faces/codes_displayText.xhtml?lawCode=LAB&division=' || CASE WHEN d > 0 THEN d || '.' ELSE '' END || '&title=&part=' || (k % 3 + i) || '.&chapter=' || CASE WHEN i > 1 THEN i || '..' ELSE '' END AS url,
  CASE WHEN d > 0 THEN 'Division ' || d ELSE '' END AS division, '' AS title, 'Part ' || (k % 3 + i) AS part, CASE WHEN i > 1 THEN 'Chapter ' || i ELSE '' END AS chapter, '' AS article, 'Part ' || i || ' & more' AS label
FROM p WHERE d IN (1, 3)""")
def contents_pages(spark, sf_dir):
    """Links of contents pages to text pages of two divisions, with the place that each has in its code."""
    key, text = F.col("page_id"), lambda c: c.cast("string")
    division = F.when(key % 5 > 0, F.concat(text(key % 5), F.lit("."))).otherwise("")
    row = lambda i: F.concat(
        F.lit(f'<p><a href="codes_displaySection.xhtml?part={i}">§ {i}</a><A class=x HREF=\''), F.lit("codes_displayText.xhtml?lawCode=LAB&amp;division="), division, F.lit("&amp;title=&amp;part="), text(key % 3 + i), F.lit(f".&amp;chapter={f'{i}..' if i > 1 else ''}'>Part <b>{i}</b>\n &amp; more</a>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("https://law.example/faces/codesTOCSelected.xhtml?tocCode=LAB").alias("url"), F.concat(*[row(i) for i in range(4)]).alias("html"))
    found = contents.contents_entries(pages, ["1", "3"])
    return found.select("page_id", "ordinal", "url", *contents.LEVELS, "label")


_CARRIED = " ".join("""
n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_suppkey % 6 AS lv, l_partkey::VARCHAR AS v FROM lineitem),
c AS (SELECT *, count(*) FILTER (lv < 1) OVER w AS a1, count(*) FILTER (lv < 2) OVER w AS a2, count(*) FILTER (lv < 3) OVER w AS a3, count(*) FILTER (lv < 4) OVER w AS a4 FROM n WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))
""".split())


@query(f"""WITH {_CARRIED} SELECT k AS l_orderkey, i AS place,
coalesce(last_value(CASE WHEN lv = 0 THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS division,
coalesce(last_value(CASE WHEN lv = 1 THEN v END IGNORE NULLS) OVER (PARTITION BY k, a1 ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS title,
coalesce(last_value(CASE WHEN lv = 2 THEN v END IGNORE NULLS) OVER (PARTITION BY k, a2 ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS part,
coalesce(last_value(CASE WHEN lv = 3 THEN v END IGNORE NULLS) OVER (PARTITION BY k, a3 ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS chapter,
coalesce(last_value(CASE WHEN lv = 4 THEN v END IGNORE NULLS) OVER (PARTITION BY k, a4 ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS article FROM c""")
def carried_levels(spark, sf_dir):
    """Headings of five levels carried forward; a higher one clears those below it."""
    level = F.try_element_at(F.array(*map(F.lit, contents.LEVELS)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, level.alias("level"), F.col("l_partkey").cast("string").alias("value"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(order))
    return contents.carried_levels(rows, "l_orderkey", order).select("l_orderkey", place.alias("place"), *contents.LEVELS)


@query("""SELECT page_id, i - 1 AS ordinal, CASE WHEN contains(h, '://') THEN h ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || h END AS url
FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages), unnest(hs) WITH ORDINALITY AS t(h, i)""")
def page_links(spark, sf_dir):
    """Every link of every page, resolved against the page's address."""
    return contents.links(table(spark, sf_dir, "pages")).select("page_id", "ordinal", "url")


# --- regulations -------------------------------------------------------------

_REGULATIONS_SQL = """
r AS (SELECT page_id AS k, (page_id * 7 % 260)::INT AS n, page_id % 4 AS kind FROM pages),
s AS (SELECT k, kind, n + CASE WHEN kind = 3 THEN 0.5 ELSE 0 END AS pos, n || CASE WHEN kind = 3 THEN '.5' ELSE '' END AS number FROM r WHERE k % 9 <> 0 AND k % 11 <> 0),
a AS (SELECT n_nationkey AS number, n_name AS name, n_nationkey * 10 AS lo, n_nationkey * 10 + 7.25 AS hi FROM nation),
m AS (SELECT k, min_by(a.number, a.number) AS number, min_by(a.name, a.number) AS name FROM s JOIN a ON pos BETWEEN lo AND hi GROUP BY k)
"""


@query(
    "WITH" + _REGULATIONS_SQL + r"""SELECT s.number || '-' || s.k AS section_number, coalesce('Art. ' || m.number || ' (' || m.name || ')', 'Unknown') AS article,
'(a) Rule ' || s.k || chr(10) || chr(10) || '(1) Each & all' || chr(10) || chr(10) || 'Authority cited: Gov. Code ' || s.k || CASE WHEN s.kind < 2 THEN chr(10) || 'Reference: Lab. Code ' || s.k ELSE '' END AS text,
'CCR Title 2 > Regulations > ' || coalesce('Art. ' || m.number || ' (' || m.name || ')', 'Unknown') || ' > § ' || s.number || ' About ' || s.k AS heading_path FROM s LEFT JOIN m USING (k)"""
)
def regulation_sections(spark, sf_dir):
    """Regulation pages in the articles of a manifest whose ranges have their numbers; reserved and empty ones are left out."""
    key, text = F.col("page_id"), lambda c: c.cast("string")
    number = F.concat(text(key * 7 % 260), F.when(key % 4 == 3, ".5").otherwise(""))
    heading = F.concat(F.lit("<h1>Cal. Code Regs. Tit. 2, § "), number, F.lit(" - About "), text(key), F.when(key % 9 == 0, " [Reserved]").otherwise(""), F.lit("</h1>"))
    body = F.when(key % 11 == 0, "<p>none</p>").otherwise(F.concat(F.lit('<div class="statereg-text"><div class="subsect indent0">(a)\n Rule '), text(key), F.lit('</div> <div class="subsect indent1">(1) Each &amp; all</div><div class="subsect"> </div></div>')))
    notes = F.concat(F.lit('<div class="statereg-notes">Note: Authority cited: Gov. Code '), text(key), F.when(key % 4 < 2, F.concat(F.lit("\nReference: Lab. Code "), text(key))).otherwise(""), F.lit("</div>"))
    pages = table(spark, sf_dir, "pages").select(key, number.alias("section_number"), F.concat(heading, body, notes).alias("html"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"), text(F.col("n_nationkey") * 10).alias("first"), F.concat(text(F.col("n_nationkey") * 10 + 7), F.lit(".3")).alias("last"))
    # A page's own number may repeat; the key tells pages apart here.
    found = contents.regulation_sections(pages, nations, "CCR Title 2", "Regulations", "2 CCR", width=10)
    mine = F.concat("section_number", F.lit("-"), F.regexp_extract("section_title", r"(\d+)$", 1))
    return found.select(mine.alias("section_number"), "article", "text", "heading_path")


# --- cascades ----------------------------------------------------------------

_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line", "supplier": "s_suppkey"}
_REFERENCES = [Reference("orders", "o_custkey", "customer"), Reference("lineitem", "l_orderkey", "orders"), Reference("lineitem", "l_suppkey", "supplier", "set null")]


def _related(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in _KEYS}
    tables["lineitem"] = tables["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey", "l_suppkey", F.lit("open").alias("status"), F.lit(1).alias("updated_at"))
    tables["orders"] = tables["orders"].withColumns({"status": F.when(F.col("o_orderkey") % 13 == 0, "archived").otherwise("open"), "updated_at": F.lit(1)})
    gone = {"customer": tables["customer"].where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("key")), "supplier": tables["supplier"].where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("key")), "orders": tables["orders"].where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("key"))}
    return tables, gone


@query("""SELECT l_orderkey * 10 + l_linenumber AS line, l_orderkey, CASE WHEN l_suppkey % 4 <> 1 THEN l_suppkey END AS l_suppkey
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) OR o_orderkey % 17 = 0)""")
def cascade_delete(spark, sf_dir):
    """What is left of the lines when a tenth of the customers, some orders and a quarter of the suppliers go."""
    tables, gone = _related(spark, sf_dir)
    return cascades.deleted(tables, _KEYS, _REFERENCES, gone)["lineitem"].select("line", "l_orderkey", "l_suppkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_custkey % 10 = 0 OR o_orderkey % 17 = 0 THEN 'archived' ELSE 'open' END AS status,
CASE WHEN o_orderkey % 13 <> 0 AND (o_custkey % 10 = 0 OR o_orderkey % 17 = 0) THEN 2 ELSE 1 END AS updated_at FROM orders""")
def cascade_archive(spark, sf_dir):
    """The orders after their customers were archived; those archived before keep their time."""
    tables, gone = _related(spark, sf_dir)
    return cascades.archived(tables, _KEYS, _REFERENCES, gone, F.lit(2))["orders"].select("o_orderkey", "status", "updated_at")


# --- change logs -------------------------------------------------------------

_RUN = StructType([StructField(n, t) for n, t in (("run_id", LongType()), ("source_id", LongType()), ("started_at", StringType()), ("completed_at", StringType()), ("status", StringType()), ("summary", StringType()))])


@query("""SELECT o_orderkey AS run_id, o_custkey AS source_id, 's' || o_orderkey AS started_at, CASE WHEN o_orderkey % 3 <> 0 THEN 'e' || o_orderkey END AS completed_at,
CASE WHEN o_orderkey % 3 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{"n": ' || o_orderkey || '}' END AS summary
FROM orders WHERE o_orderkey % 7 <> 0""")
def run_log(spark, sf_dir):
    """Runs as they are after a log of starts, ends and deletions, replayed over a snapshot from its middle."""
    log = changes.ChangeLog(shared.temporary(spark, "runs"), "run_id", _RUN)
    rows, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda p: F.concat(F.lit(p), key.cast("string"))
    log.append(changes.runs_started(rows, key * 4, key, F.col("o_custkey"), text("s")))
    log.compact(spark)
    top = rows.agg(F.max("o_orderkey")).first()[0] * 4 + 1
    ended = rows.where("o_orderkey % 3 != 0")
    log.append(changes.runs_completed(ended, top + key * 4, key, text("e"), F.when(key % 3 == 1, "completed").otherwise("failed"), F.concat(F.lit('{"n": '), key.cast("string"), F.lit("}"))))
    log.append(rows.where("o_orderkey % 7 = 0").select((top + key * 4 + 1).alias("seq"), key.alias("run_id"), F.lit(True).alias("gone")))
    return log.state(spark)
