"""Files into rows: web pages, delimited archives, spreadsheets, mail, text. Standard library parsers, in Arrow batches."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import unquoted

SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "form", "aside", "template"}


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, tables, links and emphasis of a page as Markdown; navigation and scripts left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.in_title, self.skip = "", False, 0
        self.href: list[str | None] = []
        self.rows: list[list[str]] | None = None
        self.ordered: list[int | None] = []

    def put(self, text: str) -> None:
        if self.rows is not None and self.rows:
            self.rows[-1][-1:] = [(self.rows[-1][-1] if self.rows[-1] else "") + text]
        else:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.put(f"\n\n{'#' * int(tag[1])} ")
        elif tag in ("p", "div", "section", "article"):
            self.put("\n\n")
        elif tag == "br":
            self.put("\n")
        elif tag in ("ul", "ol"):
            self.ordered.append(0 if tag == "ol" else None)
            self.put("\n")
        elif tag == "li":
            if self.ordered and self.ordered[-1] is not None:
                self.ordered[-1] += 1
                self.put(f"\n{self.ordered[-1]}. ")
            else:
                self.put("\n- ")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a":
            self.href.append(dict(attrs).get("href"))
            self.put("[" if self.href[-1] else "")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        elif tag == "title":
            self.in_title = False
        if self.skip:
            return
        if tag in ("ul", "ol") and self.ordered:
            self.ordered.pop()
            self.put("\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.put(f"]({href})" if href else "")
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            self.put("\n\n" + rows_markdown(rows) + "\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.put(re.sub(r"\s+", " ", data))


def rows_markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table padded to the widest; the first is the header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([c.strip().replace("|", "\\|") for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def page_markdown(html: str) -> tuple[str, str]:
    """(title, Markdown) of a page."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return parser.title.strip(), re.sub(r"\n{3,}", "\n\n", text).strip()


def pages_as_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of pages with title and markdown in place of the HTML."""

    convert = F.udf(page_markdown, "title string, markdown string", useArrow=False)
    return pages.withColumn("_m", convert(html)).select(*[c for c in pages.columns if c != html], "_m.*")


# The columns of the archive's section table, in order.
SECTION_COLUMNS = ("id", "law_code", "section_num", "op_statues", "op_chapter", "op_section", "effective_date", "law_section_version_id", "division", "title", "part", "chapter", "article", "history", "lob_file", "active_flg", "trans_uid", "trans_update")


def law_sections(spark: SparkSession, path: str, lobs: DataFrame) -> DataFrame:
    """Sections of a tab-separated, backtick-quoted table, each with the HTML of its companion file (`lob_file`, `html`) or ''.

    Rows with fewer than 18 columns are left out.
    """
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= len(SECTION_COLUMNS))
    rows = rows.select(*[unquoted(F.col("c")[i]).alias(n) for i, n in enumerate(SECTION_COLUMNS)])
    return rows.join(lobs, "lob_file", "left").withColumn("html", F.coalesce("html", F.lit("")))


def filtered_sections(sections: DataFrame, codes: list[str] | None = None, divisions: list[str] | None = None, active_only: bool = True) -> DataFrame:
    """Sections of the given codes (any case) and divisions (with or without a final dot)."""
    bare = lambda c: F.regexp_replace(c, r"\.$", "")
    if codes:
        sections = sections.where(F.upper("law_code").isin([c.upper() for c in codes]))
    if divisions:
        sections = sections.where(bare(F.col("division")).isin([d.rstrip(".") for d in divisions]))
    return sections.where("active_flg = 'Y'") if active_only else sections


# Kinds of files by extension.
KINDS = {
    "pdf": "pdf",
    "docx": "docx",
    "doc": "docx",
    "xlsx": "xlsx",
    "xls": "xlsx",
    "csv": "csv",
    "tsv": "tsv",
    "eml": "eml",
    "msg": "msg",
    "mbox": "mbox",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
    "tiff": "image",
    "tif": "image",
    "txt": "text",
    "md": "text",
    "log": "text",
}


def decoded(data: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def delimited_text(data: bytes) -> str:
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",\t;|")
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.reader(io.StringIO(text), dialect))
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    return rows_markdown(rows)


def message_text(data: bytes) -> str:
    """Headers, the plain body (or the HTML one without tags) and the names of attachments."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]]
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = page_markdown(text)[1]
    names = [a.get_filename() or "unnamed" for a in message.iter_attachments()]
    return "\n".join(head) + "\n\n" + text.strip() + ("\n\nAttachments: " + ", ".join(names) if names else "")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def word_text(data: bytes) -> str:
    """Paragraphs and tables of a document in order, headings marked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p" and text(e).strip():
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = re.fullmatch(r"Heading(\d)", style.get(f"{_WORD}val", "")) if style is not None else None
            out.append(("#" * int(level[1]) + " " if level else "") + text(e))
        elif e.tag == f"{_WORD}tbl":
            out.append(rows_markdown([[text(c) for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")]))
    return "\n\n".join(out)


def sheet_text(data: bytes) -> str:
    """Sheets as Markdown tables, under `## name` where there are several; blank rows and columns at the end left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        tables = []
        for name in files:
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_SHEET}c"):
                    column = 0
                    for letter in re.match("[A-Z]*", c.get("r", "A"))[0]:
                        column = column * 26 + ord(letter) - 64
                    value = c.findtext(f"{_SHEET}v") or "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    cells[column] = strings[int(value)] if c.get("t") == "s" and value else value
                rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
            while rows and not any(c.strip() for c in rows[-1]):
                rows.pop()
            width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
            tables.append(rows_markdown([r[:width] for r in rows]))
    return "\n\n".join(f"## {n}\n\n{t}" if len(tables) > 1 else t for n, t in zip(names, tables))


READERS = {"csv": delimited_text, "tsv": delimited_text, "eml": message_text, "docx": word_text, "xlsx": sheet_text, "text": decoded}


def extracted_files(files: DataFrame) -> DataFrame:
    """path, kind, text, error of `files` (path, content); a file that fails has its error and no text."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    named = files.withColumn("kind", F.try_element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    text, error = (READERS[kind](bytes(content)), None) if kind in READERS else (None, f"no reader for {kind}")
                except Exception as e:  # a broken file must not end the job
                    text, error = None, f"{type(e).__name__}: {e}"
                out.append((path, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "error"])

    return named.select("path", "kind", "content").mapInPandas(read, "path string, kind string, text string, error string")


def headings_marked(text):
    """Column: lines in capitals (4 to 99 characters) or short lines with a final colon as `##` headings, bullets as `-`."""
    def line(raw):
        bare = F.trim(raw)
        capitals = (F.length(bare) > 3) & (F.length(bare) < 100) & (F.upper(bare) == bare) & bare.rlike("[A-Z]")
        colon = bare.endswith(":") & (F.length(bare) < 80)
        bullet = bare.rlike("^[•●▪◦] *")
        return F.when(bare == "", "").when(bullet, F.regexp_replace(bare, "^[•●▪◦] *", "- ")).when(capitals | colon, F.concat(F.lit("## "), F.regexp_replace(bare, ":$", ""))).otherwise(bare)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")
