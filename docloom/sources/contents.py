"""Contents pages and regulation manifests: levels that headings set and reset, links with their place, sections in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import heading_path, tags_stripped, url_parameters

#: Levels of a code, highest first. Fixed values.
LEVELS = ("division", "title", "part", "chapter", "article")
#: Titles of sections that have no text of their own. Fixed values.
NO_SECTION = r"(?i)\[(?:Reserved|Renumbered|Repealed)\]"
#: Numbers after the point of a section, at most this many digits.
SUFFIX_DIGITS = 4


def _unescaped(text: Column) -> Column:
    """Character references of attributes and headings that matter in links and titles."""
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def joined_url(base: Column, href: Column) -> Column:
    """`href` as seen from the page `base`: absolute, //host, /path, ?query, #fragment or relative; dot segments are resolved."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base).when(href.startswith("?"), F.concat(page, href)).when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href)).otherwise(F.concat(folder, href))
    )
    head, path, tail = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)
    # One segment after another: `..` takes the last one off, `.` is nothing.
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, 100_000), F.array(F.lit("")), step)
    ends = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    resolved = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, F.array_join(kept, "/"), ends, tail)).otherwise(whole)
    return F.when(whole.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), resolved).otherwise(whole)


def links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """ordinal, href, url, label of every link of each page (others columns stay): any quotes or none, resolved against the page's address."""
    others = [c for c in pages.columns if c != html]
    tag = r"""(?is)<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(tag), F.lit(0))
    each = pages.select(*others, F.posexplode(found).alias("ordinal", "_a"))
    href = F.coalesce(*[F.nullif(F.regexp_extract("_a", tag, g), F.lit("")) for g in (1, 2, 3)], F.lit(""))
    each = each.withColumn("href", _unescaped(F.trim(href)))
    label = F.trim(F.regexp_replace(tags_stripped(F.regexp_extract("_a", tag, 4)), r"\s+", " "))
    return each.withColumns({"url": joined_url(F.col(base), F.col("href")), "label": _unescaped(label)}).drop("_a")


def contents_entries(pages: DataFrame, divisions: list[str] | None = None, marker: str = "codes_displayText.xhtml", base: str = "url") -> DataFrame:
    """ordinal, url and the levels that the address of each text page names, from contents pages (html, url, others).

    A level reads `Division 2`, `Part 1`... without the point after its number, and
    is empty where the address names none. With `divisions`, links of others and of
    none are left out. Links to other pages than texts are none of the contents.
    """
    found = links(pages, base=base).where(F.col("href").contains(marker))
    params = url_parameters(F.col("href"))
    value = lambda level: F.coalesce(F.try_element_at(params, F.lit(level)), F.lit(""))
    if divisions:
        found = found.where(F.regexp_replace(value("division"), r"\.+$", "").isin(*[d.rstrip(".") for d in divisions]))
    named = {level: F.when(value(level) == "", "").otherwise(F.concat(F.lit(f"{level.title()} "), F.regexp_replace(value(level), r"\.+$", ""))) for level in LEVELS}
    return found.withColumns(named)


def carried_levels(rows: DataFrame, by: str, order: str | list[str], level: str = "level", value: str = "value", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Rows with a column for each of `levels`: the last value set so far, unless a higher level was set after it.

    `level` names the level that a row sets (null or another name: none). A
    heading of a level clears all below it, so what is carried is always one path
    through the levels; it is '' where nothing is set. All levels come from one
    window, so the rows are sorted once.
    """
    ordered = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = {}
    for i, name in enumerate(levels):
        own = (F.col(level) == name) & F.col(value).isNotNull()
        counts = own | F.col(level).isin(*levels[:i]) if i else own
        # The last row that sets this level or clears it; a cleared one has no value.
        last = F.last(F.when(counts, F.struct(F.when(own, F.col(value)).alias("v"))), True).over(ordered)
        carried[name] = F.coalesce(last["v"], F.lit(""))
    return rows.select("*", *[c.alias(name) for name, c in carried.items()])


def page_headings(pages: DataFrame, by: str, html: str = "html") -> DataFrame:
    """by, ordinal, level, value of the headings (h3 to h5) of pages that name a level, in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<h[345]\b[^>]*>(.*?)</h[345]\s*>"), F.lit(1))
    each = pages.select(by, F.posexplode(found).alias("ordinal", "_h"))
    value = F.trim(F.regexp_replace(_unescaped(tags_stripped(F.col("_h"))), r"\s+", " "))
    named = F.lower(F.regexp_extract(F.upper(value), rf"^({'|'.join(x.upper() for x in LEVELS)})", 1))
    return each.select(by, "ordinal", named.alias("level"), value.alias("value")).where("level != ''")


# --- regulations -------------------------------------------------------------


def section_order(section: Column) -> Column:
    """A section number as a number to compare by: 11008.1 is after 11008 and before 11009; null for anything else."""
    whole, part = F.regexp_extract(section, r"^(\d+)(?:\.(\d+))?$", 1), F.regexp_extract(section, r"^(\d+)(?:\.(\d+))?$", 2)
    return F.nullif(whole, F.lit("")).cast("long") * 10**SUFFIX_DIGITS + F.coalesce(F.nullif(part, F.lit("")).cast("long"), F.lit(0))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges (low to high, both included) that hold them, by an equi join.

    The number line is cut into bins of `width`. A range stands once in each bin
    that it touches, a point in one, and only those of one bin meet. Choose the
    width near a common range's length, so that neither the copies nor the bins grow.
    Null points and ranges, and ranges that end before they begin, meet nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    met = points.withColumn("_bin", bin_of(point)).join(spread, "_bin")
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("_bin")


def regulation_sections(pages: DataFrame, articles: DataFrame, title: str, name: str, code: str, width: int = 100) -> DataFrame:
    """Regulation pages (section_number, html) as sections, each in the article of the manifest that has its number.

    articles has number, name, first and last (section numbers, included). A page without a
    heading (h1) or text, and one whose heading tells that the section is reserved,
    renumbered or repealed, is left out. Result: section_number, section_title, text
    (subdivisions as paragraphs, then authority and reference where there are
    any), article, heading_path, citation. A number that no article has goes to
    `Unknown`; of several articles the least number counts.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    plain = lambda c: F.trim(F.regexp_replace(_unescaped(tags_stripped(c)), r"\s+", " "))
    head = plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    titled = F.coalesce(F.nullif(F.trim(F.regexp_extract(head, r"§\s*[\d.]+\s*-\s*(.+)$", 1)), F.lit("")), head)
    parts = F.regexp_extract_all(html, F.lit(r"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*\bsubsect\b[^"']*["'][^>]*>(.*?)</div\s*>"""), F.lit(1))
    body = F.array_join(F.filter(F.transform(parts, plain), lambda p: p != ""), "\n\n")
    notes = _unescaped(tags_stripped(F.regexp_extract(html, r"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*\bstatereg-notes\b[^"']*["'][^>]*>(.*?)</div\s*>""", 1)))
    note = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(notes, p, 1), r"\s+", " ")), F.lit(""))
    authority, reference = note(r"(?s)Authority cited:\s*(.+?)(?:\n|Reference:|\z)"), note(r"(?s)Reference:\s*(.+?)(?:\n\n|\z)")
    text = F.concat(body, F.coalesce(F.concat(F.lit("\n\nAuthority cited: "), authority), F.lit("")), F.coalesce(F.concat(F.lit("\nReference: "), reference), F.lit("")))
    rows = pages.select("section_number", head.alias("_head"), titled.alias("section_title"), body.alias("_body"), text.alias("text"), section_order(F.col("section_number")).alias("_at"))
    rows = rows.where((F.col("_head") != "") & ~F.col("_head").rlike(NO_SECTION) & (F.col("_body") != ""))
    spans = articles.select(F.col("number").alias("_number"), F.col("name").alias("_name"), section_order(F.col("first")).alias("_low"), section_order(F.col("last")).alias("_high"))
    held = in_ranges(rows.select("section_number", "_at"), spans, "_at", "_low", "_high", width * 10**SUFFIX_DIGITS)
    held = held.groupBy("section_number").agg(F.min(F.struct("_number", "_name")).alias("_a"))
    both = rows.join(held, "section_number", "left")
    article = F.coalesce(F.concat(F.lit("Art. "), F.col("_a._number").cast("string"), F.lit(" ("), F.col("_a._name"), F.lit(")")), F.lit("Unknown"))
    path = heading_path(F.lit(title), F.lit(name), article, F.concat(F.lit("§ "), "section_number", F.lit(" "), "section_title"))
    return both.select("section_number", "section_title", "text", article.alias("article"), path.alias("heading_path"), F.concat(F.lit(f"{code} § "), "section_number").alias("citation"))


def newest(paths: DataFrame, pattern: str = r"") -> DataFrame:
    """folder, newest: of the files (path) of each folder whose names fit the pattern, the one whose name sorts last; null where none fits."""
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_replace("path", r"/[^/]*$", "")
    return paths.select(folder.alias("folder"), F.when(name.rlike(pattern), name).alias("name")).groupBy("folder").agg(F.max("name").alias("newest"))
