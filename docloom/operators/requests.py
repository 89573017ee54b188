"""Numbered requests in texts, the banks they are chosen from, and objections to them.

A text is cut into lines once; what section or request a line belongs to is then
a running window over its text's lines, so nothing but Spark functions is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators.analytics import majority
from docloom.operators.graph import spaced


def _any(column: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(p) for p in patterns])


def _number(line: Column, patterns) -> Column:
    """The number that the first fitting pattern finds in a line, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns]).cast("long")


def request_kind(text: Column) -> Column:
    """interrogatories, rfps or rfas by the title, else by most headings (the first of equal ones), else null."""
    title = F.substring(text, 1, 500)
    by_title = F.when(title.rlike(fixed.REQUEST_TITLES["rfps"]), "rfps").when(title.rlike(fixed.REQUEST_TITLES["rfas"]), "rfas").when(title.rlike(fixed.REQUEST_TITLES["interrogatories"]), "interrogatories")
    hits = {k: sum((F.regexp_count(text, F.lit("(?m)" + p)) for p in v), F.lit(0)) for k, v in fixed.REQUEST_HEADINGS.items()}
    some = reduce(lambda a, b: a + b, hits.values()) > 0
    return F.coalesce(by_title, F.when(some, majority(hits)), F.when(text.rlike(r"(?i)\bAdmit\s+that\b"), "rfas"))


def request_facts(text: Column) -> dict[str, Column]:
    """kind, propounding, responding, set_number and is_shell of a text."""
    found = lambda p: F.regexp_replace(F.trim(F.regexp_extract(text, p, 1)), "[;,]+$", "")
    return {
        "kind": request_kind(text), "propounding": found(r"(?i)PROPOUNDING\s+PARTY\s*:\s*(.+)"), "responding": found(r"(?i)RESPONDING\s+PARTY\s*:\s*(.+)"),
        "set_number": F.nullif(F.regexp_extract(text, r"(?i)SET\s+(?:NO\.?\s*|NUMBER\s*:?\s*)(\d+)", 1), F.lit("")).cast("int"), "is_shell": text.rlike("(?m)" + fixed.RESPONSE_HEADING),
    }


def _marked_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines of each text with place, start, kind, section (a heading's name), request and bare (numbers), and skipped."""
    # Texts are dealt by id before they are cut, so that a few large files still give many tasks and no line is moved later.
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id")
    rows = rows.select("id", F.coalesce(request_kind(text), F.lit("interrogatories")).alias("kind"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    line = F.col("line")
    section = reduce(lambda rest, kv: F.when(line.rlike(kv[1]), kv[0]).otherwise(rest), reversed(fixed.SKIPPED_SECTIONS.items()), F.lit(None).cast("string"))
    own = reduce(lambda rest, kv: F.when(F.col("kind") == kv[0], _number(line, kv[1])).otherwise(rest), fixed.REQUEST_HEADINGS.items(), F.lit(None).cast("long"))
    every = [p for v in fixed.REQUEST_HEADINGS.values() for p in v]
    rows = rows.withColumns({"section": section, "request": own, "bare": _number(line, [fixed.BARE_NUMBER]), "ends": _any(line, [*every, fixed.BARE_NUMBER])})
    w = Window.partitionBy("id").orderBy("place")
    event = F.when(F.col("section").isNotNull(), F.col("section")).when(F.col("ends"), "")
    state = F.last(event, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("skipped", F.coalesce(state != "", F.lit(False))).withColumn("in_section", F.when(F.col("skipped"), state)).withColumn("start", start)


def skipped_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section_type, content, defined_terms of definitions, instructions and the like.

    A section runs to the next one or to a numbered heading. Defined terms are
    runs of capitals, without common words, sorted.
    """
    lines = _marked_lines(docs, id_col, text_col).where("skipped")
    w = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.sum(F.when(F.col("section").isNotNull(), 1).otherwise(0)).over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("section").isNull(), F.struct("place", "line"))))
    found = lines.groupBy("id", "part", F.col("in_section").alias("section_type")).agg(F.regexp_replace(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("content"))
    terms = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z][A-Z\s]{2,}[A-Z])\b"), F.lit(1))), F.array(*map(F.lit, fixed.COMMON_CAPITALS))))
    return found.select(F.col("id").alias(id_col), "section_type", "content", F.when(F.col("section_type") == "definitions", terms).otherwise(F.array().cast("array<string>")).alias("defined_terms"))


def sequential(numbers: Column) -> Column:
    """Whether bare numbers look like a numbering: from 1 on, or at least three of which half follow one another."""
    steps = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size(numbers), F.lit(2))), lambda i: F.try_element_at(numbers, i) == F.try_element_at(numbers, i - 1) + 1))
    return (F.try_element_at(numbers, F.lit(1)) == 1) | ((F.size(numbers) >= 3) & (steps >= F.floor(F.size(numbers) / 2)))


def parsed_requests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 20) -> DataFrame:
    """id, ordinal (the heading's place among the text's), request_number, request_text, kind of the numbered requests of each text.

    Headings of the text's kind count, or bare numbers where it has none.
    Headings within `gap` characters of the last one kept are no new request. A
    request runs to the next one; a response within it and requests without text
    are left out. Null and empty texts have none; ids must be unique.
    """
    lines = _marked_lines(docs, id_col, text_col).where("not skipped")
    # A text's lines meet in one row, where its headings are found, and part again: nothing is read or joined twice.
    texts = lines.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "line", "start", "request", "bare"))).alias("_lines"))
    texts = texts.withColumn("is_bare", ~F.exists("_lines", lambda x: x["request"].isNotNull()))
    number = lambda x: F.when(F.col("is_bare"), x["bare"]).otherwise(x["request"])
    starts = F.transform(F.filter("_lines", lambda x: number(x).isNotNull()), lambda x: x["start"])
    lines = texts.withColumn("kept", spaced(starts, gap)).select("id", "kind", "is_bare", "kept", F.explode("_lines").alias("_l"))
    lines = lines.select("id", "kind", "is_bare", F.col("_l.place").alias("place"), F.col("_l.line").alias("line"), number(F.col("_l")).alias("number"), (number(F.col("_l")).isNotNull() & F.array_contains("kept", F.col("_l.start"))).alias("is_head"))
    every = Window.partitionBy("id")
    ordinal = F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(every.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("ordinal", ordinal).where("ordinal > 0")
    own = reduce(lambda rest, kv: F.when(F.col("kind") == kv[0], _without_heading(F.col("line"), kv[1])).otherwise(rest), fixed.REQUEST_HEADINGS.items(), F.col("line"))
    said = F.when(F.col("is_head"), F.when(F.col("is_bare"), F.regexp_replace("line", r"^\s*\d+\s*[.):\s]\s+", "")).otherwise(own)).otherwise(F.col("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"])
    found = lines.groupBy("id", "kind", "is_bare", "ordinal").agg(F.max(F.when(F.col("is_head"), F.col("number"))).alias("request_number"), F.array_join(body, "\n").alias("body"))
    bare = F.regexp_replace(F.element_at(F.split("body", "(?m)" + fixed.RESPONSE_HEADING), 1), r"^\s+|\s+$", "")
    found = found.withColumn("request_text", bare).where("request_text != ''")
    each = F.array_sort(F.collect_list(F.struct("ordinal", "request_number", "request_text")))
    texts = found.groupBy("id", "kind", "is_bare").agg(each.alias("_found"))
    texts = texts.where(~F.col("is_bare") | sequential(F.transform("_found", lambda x: x["request_number"])))
    return texts.select(F.col("id").alias(id_col), "kind", F.inline("_found")).select(id_col, "ordinal", "request_number", "request_text", "kind")


def _without_heading(line: Column, patterns) -> Column:
    return reduce(lambda rest, p: F.when(line.rlike(p), F.regexp_replace(line, p, "")).otherwise(rest), reversed(patterns), line)


# --- banks -------------------------------------------------------------------


def for_role_and_claims(bank: DataFrame, role: str | None = None, claims: list[str] | None = None) -> DataFrame:
    """Rows (applicable_roles, applicable_claims) for a role; those without claims of their own fit any."""
    kept = bank.where(F.array_contains("applicable_roles", role)) if role else bank
    return kept.where((F.size("applicable_claims") == 0) | F.arrays_overlap("applicable_claims", F.array(*map(F.lit, claims)).cast("array<string>"))) if claims is not None else kept


def bank_counts(bank: DataFrame, categories: DataFrame) -> DataFrame:
    """category, label, n of the categories (category, label, ordinal) that have rows, in their order."""
    counts = bank.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(categories, "category").withColumn("place", F.row_number().over(Window.orderBy("ordinal"))).select("category", "label", "n", "place")


def grounds_for(grounds: DataFrame, discovery_type: str | None = None, category: str | None = None) -> DataFrame:
    kept = grounds.where(F.array_contains("applies_to", discovery_type)) if discovery_type else grounds
    return kept.where(F.col("category") == category) if category else kept


def stale_grounds(grounds: DataFrame, as_of: Column, most_days: int = 180) -> DataFrame:
    """Grounds whose last_verified (text) is older than that, or no date."""
    day = F.to_date(F.try_to_timestamp("last_verified", F.lit("yyyy-MM-dd")))
    return grounds.where(day.isNull() | (F.datediff(as_of, day) > most_days))


# --- objections --------------------------------------------------------------


def request_objections(requests: DataFrame, analyses: DataFrame, grounds: DataFrame, by: str = "case_id") -> DataFrame:
    """Every request (by, request_number text) with its objections (label, explanation) in the order of grounds.

    Analyses (by, request_number, ground_id, explanation) of unknown grounds are
    left out; requests without any have none. Requests come in the order of
    their number, those without a number first.
    """
    good = analyses.join(grounds.select("ground_id", "label"), "ground_id")
    listed = good.groupBy(by, "request_number").agg(F.array_sort(F.collect_list(F.struct("ground_id", "label", "explanation"))).alias("objections"))
    none = F.array().cast(listed.schema["objections"].dataType)
    out = requests.join(listed, [by, "request_number"], "left").withColumn("objections", F.coalesce("objections", none))
    order = F.coalesce(F.expr("try_cast(request_number as int)"), F.lit(0))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, "request_number")))


def objection_text(objections: Column) -> Column:
    """Objections (label, explanation) as one paragraph."""
    return F.array_join(F.transform(objections, lambda o: F.concat(o["label"], F.lit(": "), o["explanation"])), " ")


def cited_keys(grounds: DataFrame, cited: DataFrame, by: str = "case_id") -> DataFrame:
    """Cited cases (by, ground_id, reporter_key) by what the bank (ground_id, ordinal, keys) says of the key.

    verified: it stands under that ground; other_ground: under another; unverified: nowhere.
    """
    every = grounds.select(F.col("ground_id").alias("_of"), "ordinal", F.explode("keys").alias("reporter_key"))
    last = every.groupBy("reporter_key").agg(F.max_by("_of", "ordinal").alias("_of"))
    status = F.when(F.col("_of").isNull(), "unverified").when(F.col("_of") == F.col("ground_id"), "verified").otherwise("other_ground")
    return cited.join(last, "reporter_key", "left").select(by, "ground_id", "reporter_key", status.alias("status"))


def shell_filled(markers: DataFrame, results: DataFrame, enabled: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case the markers of a response shell, and those for which there is an objection that is not switched off."""
    on = results.join(enabled, [by, "request_number"], "left").where(F.coalesce("is_enabled", F.lit(True))).select(by, "request_number").distinct()
    joined = markers.join(on.withColumn("_on", F.lit(True)), [by, "request_number"], "left")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("n_markers"), F.count("_on").alias("n_filled"))


def in_category(bank: DataFrame, categories: list[str], order: str = "ordinal") -> DataFrame:
    """Rows of the given categories with place: categories in the order given, rows in the bank's order; a category given twice counts once."""
    ranks = F.create_map(*[x for i, c in enumerate(dict.fromkeys(categories)) for x in (F.lit(c), F.lit(i))])
    kept = bank.where(F.col("category").isin(categories)).withColumn("rank", F.try_element_at(ranks, F.col("category")))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(order)))


def ground(grounds: DataFrame, wanted: DataFrame, key: str = "ground_id") -> DataFrame:
    """wanted (key) with the ground of that key, null where there is none."""
    return wanted.join(grounds, key, "left")


def ground_index(grounds: DataFrame, key: str = "ground_id") -> DataFrame:
    """category, n, keys: how many grounds each category has, and their keys in order."""
    return grounds.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))
