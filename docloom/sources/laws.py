"""Legal sources into sections: statute pages, jury instructions, manuals and opinions, as segmented lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import heading_path, subdivisions, tags_stripped
from docloom.operators.graph import without_adjacent_repeats
from docloom.operators.store import latest

# Names of codes in citations.
CODE_CITATIONS = {
    "LAB": "Cal. Lab. Code",
    "GOV": "Cal. Gov. Code",
    "UIC": "Cal. Unemp. Ins. Code",
    "BPC": "Cal. Bus. & Prof. Code",
    "CCP": "Cal. Code Civ. Proc.",
}
# Jury instruction series by the hundreds of their number, and the ranges kept.
SERIES = {
    24: "Wrongful Termination",
    25: "FEHA Discrimination and Harassment",
    26: "CFRA Leave",
    27: "Labor Code Violations",
    28: "Workers' Compensation",
    46: "Whistleblower Protection",
}
INSTRUCTION_START = r"^(\d{4}[A-Z]?)\.\s+(.+)"
PAGE_FURNITURE = (r"^\d{3,4}$", r"^CACI\s+No\.\s+\d+[A-Z]?\s+\S+", r"^\S+\s+CACI\s+No\.\s+\d+[A-Z]?$", r"^VF-\d+\s+\S+", r"^\S+\s+VF-\d+$", r"^This version provided b")
DATE_LINE = r"^(New|Revised|Renumbered|Revoked|Restored)\s+\w+\s+\d{4}"
PARTS = {"Directions for Use": "directions", "Sources and Authority": "sources", "Secondary Sources": "secondary"}
MONTH_LINE = r"(?i)^(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)[,]?\s*\d{4}$"


def citation_of(code: Column, section: Column) -> Column:
    """`<code's name> § <section>`, brackets and a final dot taken off the section; unknown codes stand as they are."""
    names = F.create_map(*[F.lit(x) for kv in CODE_CITATIONS.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(names, code), code), F.lit(" § "), F.regexp_replace(F.regexp_replace(section, r"[\[\]]", ""), r"\.$", ""))


def page_sections(pages: DataFrame, html: str = "html", heading: str = "h6") -> DataFrame:
    """Rows of pages cut at headings with a section number: ordinal, section_number, text, amendment, effective_date, subdivisions.

    A section runs to the next such heading. A block that tells of an amendment
    is not text; blank sections are left out, and null pages have none.
    """
    others = [c for c in pages.columns if c != html]
    pieces = F.split(F.coalesce(F.col(html), F.lit("")), rf"(?i)<{heading}[^>]*>(?=\s*(?:<[^>]+>\s*)*\[?\d+(?:\.\d+)*[.\]])")
    cut = pages.select(*others, F.posexplode(pieces).alias("ordinal", "_piece")).where("ordinal > 0")
    number = F.regexp_extract(tags_stripped(F.element_at(F.split("_piece", f"(?i)</{heading}>"), 1)), r"^\s*\[?(\d+(?:\.\d+)*)", 1)
    body = F.concat_ws("", F.slice(F.split("_piece", f"(?i)</{heading}>"), 2, 1_000_000))
    blocks = F.filter(F.split(tags_stripped(body), "\n"), lambda b: F.trim(b) != "")
    amended = lambda b: b.rlike(r"(?i)\((?:Amended|Added|Repealed|Enacted)\b")
    note = F.try_element_at(F.filter(blocks, amended), F.lit(-1))
    return cut.select(
        *others, "ordinal", number.alias("section_number"), F.array_join(F.filter(blocks, lambda b: ~amended(b)), "\n\n").alias("text"), F.regexp_replace(note, r"^[() ]+|[() ]+$", "").alias("amendment"),
        F.nullif(F.regexp_extract(note, r"(?i)Effective ([A-Z][a-z]+ \d{1,2}, \d{4})", 1), F.lit("")).alias("effective_date"),
    ).where("trim(text) != ''").withColumn("subdivisions", subdivisions(F.regexp_replace("text", "\n\n", "\n")))


def _lines(pages: DataFrame, by: str, page: str, text: str, keep: Column) -> DataFrame:
    """by, place, line: the trimmed lines of the pages kept, in order of page and line."""
    rows = pages.where(keep).select(by, page, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_i", "line"))
    w = Window.partitionBy(by).orderBy(page, "_i")
    return rows.select(by, F.row_number().over(w).alias("place"), F.trim("line").alias("line"))


def _joined(value: Column) -> Column:
    lines = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("place", value.alias("said"))))), lambda x: x["said"])
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def instructions(pages: DataFrame, by: str = "book_id", page: str = "page", text: str = "text", ranges=((2400, 2499), (2500, 2599), (2600, 2699), (2700, 2799), (2800, 2899), (4600, 4699))) -> DataFrame:
    """Numbered instructions of paged books: number, title, series, instruction, directions, sources.

    Pages that list three or more numbers and forms (VF-) are left out, as are
    page headers and numbers. Lines belong to the last start before them, and
    within it to the last part heading; reserved numbers start nothing. Secondary
    sources go below the sources; a date line at an instruction's end is cut.
    """
    listing = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)" + INSTRUCTION_START)) >= 3
    lines = _lines(pages, by, page, text, ~listing & ~F.coalesce(F.ltrim(F.col(text)).rlike(r"^VF-\d{4}"), F.lit(False)))
    lines = lines.where(~reduce(lambda a, b: a | b, [F.col("line").rlike(p) for p in PAGE_FURNITURE]))
    start = F.col("line").rlike(INSTRUCTION_START)
    lines = lines.where(~(start & F.col("line").contains("Reserved"))).withColumn("starts", start)
    w = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ordinal", F.sum(F.col("starts").cast("int")).over(w)).where("ordinal > 0")
    parts = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    event = F.when(F.col("starts"), F.lit("instruction")).otherwise(F.try_element_at(parts, F.col("line")))
    within = Window.partitionBy(by, "ordinal").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("event", event).withColumn("part", F.last("event", True).over(within))
    said = lambda p: _joined(F.when((F.col("part") == p) & F.col("event").isNull(), F.col("line")))
    head = F.max(F.when(F.col("starts"), F.col("line")))
    found = lines.groupBy(by, "ordinal").agg(head.alias("head"), *[said(p).alias(p) for p in ("instruction", "directions", "sources", "secondary")])
    number = F.regexp_extract("head", INSTRUCTION_START, 1)
    value = F.regexp_extract(number, r"^\d+", 0).cast("int")
    series = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SERIES.items() for x in kv]), F.floor(value / 100).cast("int")), F.concat(F.lit("Series "), F.floor(value / 100).cast("string"), F.lit("00")))
    sources = F.when((F.col("sources") != "") & (F.col("secondary") != ""), F.concat("sources", F.lit("\n\nSecondary Sources\n"), "secondary")).otherwise(F.concat("sources", "secondary"))
    kept = found.where(reduce(lambda a, b: a | b, [value.between(a, b) for a, b in ranges]))
    return kept.select(by, number.alias("number"), F.regexp_extract("head", INSTRUCTION_START, 2).alias("title"), series.alias("series"), F.regexp_replace("instruction", rf"\n*{DATE_LINE[1:]}[^\n]*$", "").alias("instruction"), "directions", sources.alias("sources"))


def instruction_sections(rows: DataFrame, by: str = "book_id") -> DataFrame:
    """Instructions as one row for each part with text: citation, heading_path, text."""
    labels = {"instruction": "Instruction Text", "directions": "Directions for Use", "sources": "Sources and Authority"}
    long = rows.unpivot([by, "number", "title", "series"], list(labels), "part", "text").where("trim(text) != ''")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("part"))
    path = F.concat(F.lit("CACI > "), "series", F.lit(" > No. "), "number", F.lit(" — "), "title", F.lit(" > "), label)
    return long.select(by, F.concat(F.lit("CACI No. "), "number").alias("citation"), path.alias("heading_path"), "text")


def chapters(pages: DataFrame, by: str = "book_id", page: str = "page", text: str = "text", start: str = r"^(\d{1,2})\.?\s+([A-Z].*)$", stop: str = "ADDENDUM", first_page: int = 0) -> DataFrame:
    """Chapters of paged manuals: number, title, text, start_line.

    A chapter starts at a numbered heading of at least four characters of which
    60 % of the letters are capitals. Page numbers like `2 - 1` and lines with a
    month alone are left out; nothing counts from the first page with the stop
    word on. Chapters without text are left out.
    """
    stopped = F.max(F.coalesce(F.col(text).contains(stop), F.lit(False))).over(Window.partitionBy(by).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    body = pages.withColumn("_stopped", stopped).where("not _stopped")
    lines = _lines(body, by, page, text, F.col(page) >= first_page)
    lines = lines.where(~F.col("line").rlike(r"^\d{1,2}\s*-\s*\d{1,2}$") & ~F.col("line").rlike(MONTH_LINE))
    title = F.trim(F.regexp_extract("line", start, 2))
    capitals = F.regexp_count(title, F.lit(r"\p{Lu}")) / F.nullif(F.regexp_count(title, F.lit(r"\p{L}")), F.lit(0))
    lines = lines.withColumn("starts", F.coalesce((F.length(title) >= 4) & (capitals >= 0.6), F.lit(False)))
    w = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ordinal", F.sum(F.col("starts").cast("int")).over(w)).where("ordinal > 0")
    head = F.max(F.when(F.col("starts"), F.col("line")))
    found = lines.groupBy(by, "ordinal").agg(head.alias("head"), _joined(F.when(~F.col("starts"), F.col("line"))).alias("text"), F.min("place").alias("start_line"))
    return found.where("text != ''").select(by, F.regexp_extract("head", start, 1).alias("number"), F.trim(F.regexp_extract("head", start, 2)).alias("title"), "text", "start_line")


def without_signature(text: Column, sign: str = r"(?m)^\s*(?:Sincerely|Very truly yours|Yours truly)\b") -> Column:
    """The text up to the first signature line."""
    return F.regexp_replace(F.element_at(F.split(text, sign, 2), 1), r"\s+$", "")


def toc_sections(toc: DataFrame, key: str = "section_number", most_depth: int = 20) -> DataFrame:
    """Leaves of a table of contents (id, parent, name, section_number) with their path; the first by path and id of each number."""
    from docloom.operators.graph import tree_paths

    paths = tree_paths(toc.select("id", "parent", "name"), most_depth)
    leaves = toc.where(F.col(key).isNotNull()).select("id", key).join(paths, "id")
    return latest(leaves, key, "path", "id")


def block_text(blocks: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Text blocks of a section joined, without those that repeat the one before."""
    kept = without_adjacent_repeats(blocks, by, order, value)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return kept.groupBy(by).agg(F.array_join(rows, "\n\n").alias("text"))


# --- opinions ----------------------------------------------------------------


def employment_codes(text: Column, reporters: Column | None = None) -> Column:
    """Sorted labels of the codes that citations (an array of reporters) or the whole text name."""
    fits = lambda where, patterns: reduce(lambda a, b: a | b, [where.rlike("(?i)" + p) for p in patterns])
    found = [F.when(fits(text, p) | (F.exists(reporters, lambda r: fits(r, p)) if reporters is not None else F.lit(False)), F.lit(label)) for label, p in fixed.EMPLOYMENT_CODES.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def employment_signal(text: Column, sections: Column | None = None) -> Column:
    """Whether a cited section is a key one, or two of the terms stand in the text."""
    low = F.lower(text)
    terms = sum((low.contains(t).cast("int") for t in fixed.EMPLOYMENT_TERMS), F.lit(0)) >= 2
    if sections is None:
        return terms
    bare = F.transform(sections, lambda s: F.trim(F.element_at(F.split(s, "-"), 1)))
    return F.arrays_overlap(bare, F.array(*map(F.lit, fixed.EMPLOYMENT_SECTIONS))) | terms


def relevant_opinions(searches: list[DataFrame], key: str = "cluster_id", text: str = "text", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted opinions with their codes, outcome counts) of several searches.

    An opinion that several searches find counts once, in the first one. Those
    that name a code and have a strong signal are accepted; `most` stops
    early, by search and key.
    """
    every = reduce(DataFrame.unionByName, [s.withColumn("search", F.lit(i)) for i, s in enumerate(searches)])
    once = latest(every, key, "search")
    judged = once.withColumn("codes", employment_codes(F.coalesce(F.col(text), F.lit("")))).withColumn("outcome", F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no text").when(F.size("codes") == 0, "rejected").when(employment_signal(F.col(text)), "accepted").otherwise("rejected"))
    counts = judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    accepted = judged.where("outcome = 'accepted'").drop("outcome")
    return (accepted.orderBy("search", key).limit(most) if most else accepted), counts


def html_text(html: Column) -> Column:
    """The text of HTML: blocks are lines, tags within a line are nothing, white space is one space, references are characters."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6])\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for code, char in (("&nbsp;", " "), ("&sect;", "§"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def archive_statutes(sections: DataFrame, base: str = "") -> DataFrame:
    """Rows of an archive (`files.law_sections`) with text, citation, subdivisions, hierarchy, amendment and source_url.

    Text is that of the HTML; rows without any are left out. Levels that are
    given read `Division 2`, joined from the highest on; an empty history is none.
    """
    told = sections.withColumn("text", html_text(F.col("html"))).where(F.trim("text") != "")
    level = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c.title()} "), F.col(c)))
    return told.withColumns({
        "citation": citation_of(F.col("law_code"), F.col("section_num")), "subdivisions": subdivisions(F.col("text")), "hierarchy": heading_path(*map(level, ("division", "title", "part", "chapter", "article"))), "amendment": F.nullif("history", F.lit("")),
        "source_url": F.concat(F.lit(f"{base}/faces/codes_displaySection.xhtml?lawCode="), "law_code", F.lit("&sectionNum="), "section_num"),
    }).drop("html", "history")
