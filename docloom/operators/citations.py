"""Citations: extract, link, resolve, verify, score."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed import CASE_REPORTERS, STATE_REPORTERS
from docloom.functions.text import first_match
from docloom.operators.store import latest

#: A reporter citation: volume, reporter, page.
REPORTERS = r"(\d{1,4}) ((?:Cal\.(?: ?App\.)?|U\.S\.|F\.)(?: ?(?:2d|3d|4th|5th))?) (\d{1,5})"
STATUTES = r"((?:[A-Z][a-z]+\. )+Code) §+ ?(\d+(?:\.\d+)?)"


def extracted(rows: DataFrame, text: str) -> DataFrame:
    """One row per citation of each text: citation_type, cited_text, position in its list, and volume, reporter, page or section."""
    cases = F.transform(F.regexp_extract_all(F.col(text), F.lit(REPORTERS), F.lit(0)), lambda c: F.struct(F.lit("case").alias("citation_type"), c.alias("cited_text")))
    laws = F.transform(F.regexp_extract_all(F.col(text), F.lit(STATUTES), F.lit(0)), lambda c: F.struct(F.lit("statute").alias("citation_type"), c.alias("cited_text")))
    out = rows.select("*", F.posexplode(F.concat(cases, laws)).alias("position", "_c")).select(*[c for c in rows.columns if c != text], "position", "_c.*")
    return _with_parts(out)


def _with_parts(citations: DataFrame) -> DataFrame:
    part = lambda p, i: F.nullif(F.regexp_extract("cited_text", p, i), F.lit(""))
    case = F.col("citation_type") == "case"
    return citations.withColumns({"volume": F.when(case, part(REPORTERS, 1)), "reporter": F.when(case, part(REPORTERS, 2)), "page": F.when(case, part(REPORTERS, 3)), "section": F.when(~case, part(STATUTES, 2))})


def links(citations: DataFrame, source: str = "chunk_id") -> DataFrame:
    """The first of each (source, cited text).

    Where citations have nothing besides their source and what the cited text
    tells, the least position is all that has to be found, and no row is sorted.
    """
    if set(citations.columns) != {source, "position", "citation_type", "cited_text", "volume", "reporter", "page", "section"}:
        return latest(citations, [source, "cited_text"], "position")
    return _with_parts(citations.groupBy(source, "citation_type", "cited_text").agg(F.min("position").alias("position"))).select(*citations.columns)


def section_prefixes(citation: Column) -> Column:
    """Every prefix of what follows `§ ` in a citation, so that a prefix match is an equi join."""
    section = F.regexp_extract(citation, r"§ (.*)$", 1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(section), F.lit(1))), lambda i: F.substring(section, F.lit(1), i))


def resolved(links_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Statute links with target_chunk_id: the least id of active chunks whose citation has `§ ` and then the section.

    A section fits longer ones that begin alike too. Chunks are keyed by every
    prefix of their section (a few short strings each), which turns the
    substring match into an equi join with a pre-aggregated side.
    """
    keyed = chunks.where("is_active").select("chunk_id", F.explode(section_prefixes(F.col("citation"))).alias("section")).where("section != ''")
    least = keyed.groupBy("section").agg(F.min("chunk_id").alias("target_chunk_id"))
    return links_.join(least.hint("merge"), "section", "left")


def best_chunk(links_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per section the chunk to quote: active ones first, then the least id; with whether it is active."""
    # Two plain minima instead of one of structs, which would have to be sorted. The prefixes are many times the rows that
    # their size is estimated by: without the hint they would be broadcast.
    active = F.coalesce(F.col("is_active"), F.lit(False))
    keyed = chunks.select(F.when(active, F.col("chunk_id")).alias("_active"), F.when(~active, F.col("chunk_id")).alias("_other"), F.explode(section_prefixes(F.col("citation"))).alias("section"))
    best = keyed.groupBy("section").agg(F.min("_active").alias("_active"), F.min("_other").alias("_other"))
    return links_.join(best.select("section", F.coalesce("_active", "_other").alias("chunk_id"), F.col("_active").isNotNull().alias("found_active")).hint("merge"), "section", "left")


def statute_status(found_active: Column, age_days: Column, most_age: int = 30) -> Column:
    return first_match([(found_active.isNull(), "not_found"), (~found_active, "repealed"), (age_days > most_age, "amended")], "verified")


def confidence(status: Column) -> Column:
    """How far an answer may rely on a citation of that status."""
    return first_match([(status == "verified", "verified"), (status.isin("amended", "not_found", "ambiguous"), "unverified")], "suspicious")


def short_forms(citations: DataFrame, by: str = "document_id", order: str = "position") -> DataFrame:
    """Each citation with the last full one before it: antecedent of short forms; the full one's flag passes on."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    full = F.last(F.when(F.col("is_full"), F.col("cited_text")), True).over(w)
    flag = F.last(F.when(F.col("is_full"), F.col("is_state")), True).over(w)
    return citations.withColumns({"antecedent": full, "state": F.when(F.col("is_full"), F.col("is_state")).otherwise(F.coalesce(flag, F.lit(False)))})


def reporter_keys(grounds: DataFrame) -> DataFrame:
    """Reporter keys of grounds (ground_id, ordinal, keys) with their ground; of several the last."""
    return grounds.select("ground_id", "ordinal", F.explode("keys").alias("key")).groupBy("key").agg(F.max_by("ground_id", "ordinal").alias("ground_id"))


def supported(answer: DataFrame, context: DataFrame, by: str = "query_id") -> DataFrame:
    """Citations of answers (code, section) with whether the context has the section, and the same code where both name one."""
    c = context.select(by, "section", F.col("code").alias("_code")).distinct()
    joined = answer.join(c, [by, "section"], "left").withColumn("_ok", F.col("_code").isNotNull() | F.col("section").isNull())
    fits = F.coalesce((F.col("_code") == F.col("code")) | F.col("code").isNull() | (F.col("_code") == ""), F.lit(False))
    return joined.groupBy(by, "section", "code").agg(F.bool_or(fits).alias("supported"))


# --- case citations against the store and a lookup ---------------------------

def case_keys(citation: Column, reporters: tuple[str, ...] = CASE_REPORTERS) -> Column:
    """Each `volume reporter page` that a citation holds as a substring: the volume's last digits, the page's first ones.

    A link to `5 Cal. 4` is found in `15 Cal. 45` as well, as a substring match
    finds it; so each citation gives a few short keys, and the match is an equi join.
    """
    names = "|".join(re.escape(r) for r in sorted(reporters, key=lambda r: (-len(r), r)))
    hits = [F.regexp_extract_all(citation, F.lit(rf"(\d+ (?:{n}) \d+)"), F.lit(1)) for n in (names, *sorted(re.escape(r) for r in reporters))]
    # Digits of the volume from any place on, and of the page up to any place.
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.length(F.regexp_extract(c, r"^(\d+)", 1))), lambda i: c.substr(i, F.length(c)))
    heads = lambda c: F.transform(F.sequence(F.lit(0), F.length(F.regexp_extract(c, r"(\d+)$", 1)) - 1), lambda i: c.substr(F.lit(1), F.length(c) - i))
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(F.flatten(F.array(*hits)), tails)), heads)))


def resolved_cases(links_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Case links with target_chunk_id: the least id of active case-law chunks whose citation holds `volume reporter page`.

    Links without one of the three, and those that nothing holds, get null.
    """
    some = chunks.where("is_active and content_category = 'case_law' and citation is not null")
    least = some.select("chunk_id", F.explode(case_keys(F.col("citation"))).alias("_key")).groupBy("_key").agg(F.min("chunk_id").alias("target_chunk_id"))
    keyed = links_.withColumn("_key", F.concat(F.col("volume"), F.lit(" "), F.col("reporter"), F.lit(" "), F.col("page")))
    return keyed.join(least, "_key", "left").drop("_key")


def of_state(reporter: Column, court: Column) -> Column:
    """Whether a case is the state's: by its reporter, or by a court's name that starts with `cal` or `ca.`."""
    court = F.lower(court)
    return F.coalesce(reporter.isin(*STATE_REPORTERS), F.lit(False)) | F.coalesce(court.startswith("cal") | court.startswith("ca."), F.lit(False))


def verified_cases(citations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Case citations (reporter, volume, page, year, is_state) with status, case_name and year_filed by a staged lookup.

    lookup has reporter, volume, page, ordinal, code, error, matched (the
    citation found) and clusters (case_name, date_filed). Other states'
    citations, and those without all of reporter, volume and page, are left out.
    Of several answers the one of least ordinal counts. An answer of 300 is
    ambiguous; 404, none, or one without clusters is not found.
    """
    keys = ["reporter", "volume", "page"]
    asked = citations.where(F.col("is_state") & F.col("reporter").isNotNull() & F.col("volume").isNotNull() & F.col("page").isNotNull())
    first = lookup.groupBy(*keys).agg(F.min_by(F.struct("code", "error", "matched", F.try_element_at("clusters", F.lit(1)).alias("cluster")), "ordinal").alias("_r"))
    r, cluster, code = F.col("_r"), F.col("_r.cluster"), F.col("_r.code")
    found = r.isNotNull() & cluster.isNotNull() & code.isNotNull() & ~code.isin(300, 404) & F.col("_r.error").isNull()
    filed = F.nullif(F.substring(cluster["date_filed"], 1, 4), F.lit(""))
    ours = reduce(lambda a, b: a | b, [F.contains(F.col("_r.matched"), F.lit(x)) for x in STATE_REPORTERS])
    status = first_match([
        (F.col("_r.error").isNotNull(), "error"), (r.isNull() | (code == 404), "not_found"), (code == 300, "ambiguous"), (cluster.isNull(), "not_found"),
        (~F.coalesce(ours, F.lit(False)), "wrong_jurisdiction"), (F.col("year") != filed, "date_mismatch"),
    ], "verified")
    joined = asked.join(first, keys, "left")
    return joined.withColumns({"status": status, "case_name": F.when(found, cluster["case_name"]), "year_filed": F.when(found, filed)}).drop("_r")


def first_number(citation: Column) -> Column:
    """The section that a citation names: its first number; null without one."""
    return F.nullif(F.regexp_extract(citation, r"(\d+(?:\.\d+)?)", 1), F.lit(""))


def share_known(rows: DataFrame, known: DataFrame, by: str, citation: str = "citation", on: list[str] | None = None) -> DataFrame:
    """by, share: of each group's citations those whose first number one of `known` has too (within `on`); repeats count each."""
    keys = on or []
    there = known.select(*keys, first_number(F.col(citation)).alias("_n")).where("_n is not null").distinct().withColumn("_hit", F.lit(1))
    joined = rows.withColumn("_n", first_number(F.col(citation))).join(there, [*keys, "_n"], "left")
    return joined.groupBy(by).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("share"))


def cited_chunks(cited: DataFrame, context: DataFrame, by: str = "query_id") -> DataFrame:
    """Citations (by, ordinal, document_index, cited_text) with the chunk at that place of the context; each chunk's first one stays.

    Places outside of the context, and null ones, are left out.
    """
    joined = cited.join(context.withColumnRenamed("position", "document_index"), [by, "document_index"])
    return latest(joined, [by, "chunk_id"], "ordinal")


def context_citations(context: DataFrame) -> DataFrame:
    """A citation without a claim for every row of the context: what an answer falls back on."""
    return context.select("query_id", F.lit("").alias("claim_text"), "chunk_id", "source_url", "citation", "content_category")


def neighbours(edges: DataFrame, asked: DataFrame, src: str = "chunk_id", dst: str = "target_chunk_id") -> DataFrame:
    """asked, direction, other: the links out of (forward) and into (reverse) each asked chunk."""
    a = asked.select(F.col(src).alias("asked")).distinct()
    out = edges.join(a, F.col(src) == F.col("asked")).select("asked", F.lit("forward").alias("direction"), F.col(dst).alias("other"))
    into = edges.join(a, F.col(dst) == F.col("asked")).select("asked", F.lit("reverse").alias("direction"), F.col(src).alias("other"))
    return out.unionByName(into)
