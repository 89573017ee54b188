"""Column functions on texts and URLs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def first_match(cases: Iterable[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    cases = list(cases)
    return reduce(lambda rest, case: F.when(case[0], lit(case[1])).otherwise(rest), reversed(cases), lit(otherwise))


def language_of_url(url: Column) -> Column:
    return first_match([(url.rlike("(?i)" + p), code) for p, code in fixed.LANGUAGE_PATTERNS], fixed.DEFAULT_LANGUAGE)


def category_of_url(url: Column, content_type: Column) -> Column:
    """A document's category from its URL and type, cases in order."""
    low = F.lower(url)
    any_of = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    pdf = content_type == "pdf"
    return first_match(
        [
            (low.contains("leginfo.legislature.ca.gov"), "statutory_code"),
            (pdf & any_of("fact-sheet", "factsheet", "fact_sheet"), "fact_sheet"),
            (pdf & any_of("poster", "notice"), "poster"),
            (any_of("faq", "frequently-asked", "questions"), "faq"),
        ],
        "agency_guidance",
    )


def normalize_url(url: Column) -> Column:
    """The URL without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([^/?]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def scope_of_url(url: Column, allow: list[str], block: list[str]) -> Column:
    """out_of_scope where a block pattern fits or no allow pattern does, else pdf_download or in_scope."""
    clean = normalize_url(url)
    fits = lambda patterns: reduce(lambda a, b: a | b, [clean.rlike("(?i)" + p) for p in patterns], F.lit(False))
    pdf = F.lower(F.regexp_extract(clean, r"^[^/?]*://[^/?]*([^?]*)", 1)).endswith(".pdf")
    return first_match([(fits(block), "out_of_scope"), (~fits(allow), "out_of_scope"), (pdf, "pdf_download")], "in_scope")


def url_parameters(url: Column) -> Column:
    """The query string as a map; empty without one."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(query, F.lit("&"), F.lit("=")))


def links_of(html: Column) -> Column:
    """The distinct link targets of well-formed HTML, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)'), F.lit(1)))


def tags_stripped(html: Column) -> Column:
    """The text between tags, each run of tags a newline."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", ""), r"(\s*<[^>]*>\s*)+", "\n"))


def cleaned(text: Column, boilerplate: Iterable[str] = fixed.BOILERPLATE) -> Column:
    """A text without typographic characters, boilerplate and superfluous white space.

    Headings, list items and table rows keep their inner spacing. Empty or null
    gives the empty string.
    """
    out = F.coalesce(text, F.lit(""))
    for bad, good in [*fixed.CHARACTERS.items(), *fixed.MOJIBAKE.items()]:
        out = F.replace(out, F.lit(bad), F.lit(good))
    for pattern in boilerplate:
        out = _without(out, pattern, fixed.BOILERPLATE_WORDS.get(pattern))

    def line(raw: Column) -> Column:
        bare = _trimmed(raw)
        structured = bare.startswith("#") | bare.startswith("-") | bare.startswith("|") | bare.rlike(r"^\d+\.")
        spaced = bare.contains("  ") | bare.contains("\t")
        return F.when(spaced & ~structured, F.regexp_replace(bare, r"[ \t]+", " ")).otherwise(bare)

    joined = F.array_join(F.transform(F.split(out, "\n"), line), "\n")
    return _trimmed(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def _trimmed(text: Column) -> Column:
    """Without the white space of a pattern's `\\s` at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _without(text: Column, pattern: str, words: tuple[str, ...] | None) -> Column:
    """Without what the pattern matches; with `words`, only a text that has one of them (small letters: in any case) is searched."""
    if not words:
        return F.regexp_replace(text, pattern, "")
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t) if w == w.lower() else t, F.lit(w)) for w in words])
    # An array of one names the text, so that it is not made again wherever it is used.
    return F.transform(F.array(text), lambda t: F.when(some(t), F.regexp_replace(t, pattern, "")).otherwise(t))[0]


def sanitized(text: Column) -> Column:
    """NFC, without control characters, at most two newlines or spaces in a row, trimmed.

    Only texts with characters that NFC may change go to Python, a few rows at a time.
    """
    risky = text.rlike(rf"[^{fixed.NFC_SAFE}]")
    composed = F.udf(lambda t: None if t is None else normalize("NFC", t), "string", useArrow=False)(F.when(risky, text))
    plain = F.regexp_replace(F.coalesce(composed, text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r" {3,}", "  "))


def injection_in(text: Column) -> Column:
    """The first sign of an attempt to override instructions, null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in fixed.INJECTION])


def question_parts(query: Column) -> dict[str, Column]:
    """normalized, has_citation, cited_section and cited_code of a question."""
    found = [query.rlike(p) for p, _, _ in fixed.QUERY_CITATIONS]
    section = first_match([(f, F.regexp_extract(query, p, s) if s else F.lit(None).cast("string")) for f, (p, _, s) in zip(found, fixed.QUERY_CITATIONS)], F.lit(None).cast("string"))
    raw = F.regexp_extract(query, fixed.QUERY_CITATIONS[0][0], 1)
    names = F.create_map(*[F.lit(x) for pair in fixed.CODE_NAMES.items() for x in pair])
    code = F.when(found[0], F.coalesce(F.try_element_at(names, F.split(F.lower(raw), r"\s+")[0]), raw))
    normalized = F.regexp_replace(F.trim(F.regexp_replace(query, r"\s+", " ")), r"[?.!,;:]+$", "")
    return {"normalized": normalized, "has_citation": reduce(lambda a, b: a | b, found), "cited_section": F.nullif(section, F.lit("")), "cited_code": code}


def reading_level(text: Column, digits: int = 1) -> Column:
    """Flesch-Kincaid grade with 1.3 syllables a word."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    return F.when(words == 0, F.lit(0.0)).otherwise(F.round(F.lit(0.39) * words / sentences + F.lit(11.8 * 1.3) - 15.59, digits))


def filled(template: Column, variables: dict[str, Column]) -> Column:
    """A template with each {NAME} replaced; unknown names stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), variables.items(), template)


def subdivisions(text: Column) -> Column:
    """The distinct markers like (a) that lines begin with, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\([a-z]\))\s"), F.lit(1)))


def statute_mentions(text: Column) -> Column:
    """Every `<code> Code § <section>` in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?:[A-Z][a-z]+\. )+Code §+ ?\d+(?:\.\d+)?"), F.lit(0))


def title_case(text: Column, upper: tuple[str, ...] = (), lower: tuple[str, ...] = ()) -> Column:
    """Words with a capital; acronyms in upper case, small words but the first in lower case."""
    def word(w: Column, i: Column) -> Column:
        return F.when(F.upper(w).isin(*upper), F.upper(w)).when((i > 0) & F.lower(w).isin(*lower), F.lower(w)).otherwise(F.initcap(w))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def unquoted(value: Column, required: bool = False) -> Column:
    """A value without backticks; the word NULL is null, or empty where required."""
    bare = F.trim(value)
    inner = F.when(bare.rlike("^`.*`$"), F.regexp_replace(bare, "^`|`$", "")).otherwise(bare)
    return F.when(bare == "NULL", F.lit("") if required else F.lit(None).cast("string")).otherwise(inner)


def heading_path(*levels: Column) -> Column:
    """The non-empty levels joined by ` > `."""
    return F.array_join(F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != "")), " > ")


def first_filled(*columns: Column, more_than: int = 50) -> Column:
    """The first column whose trimmed text is longer than `more_than`."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > more_than, c) for c in columns])


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table, padded to the widest row, the first row as header."""
    width = F.aggregate(rows, F.lit(0), lambda m, r: F.greatest(m, F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
