"""Texts into chunks: texts are cut, measured and joined by SQL functions; only the sizes of parts go through a fold.

A fold over sizes (whole numbers) says which parts make a
chunk; no text leaves the JVM, and nothing is shuffled: all parts of a text stay in
its row until they are exploded in order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.folds import LOOSE, NEVER, RUNS, STRICT, ancestors, merged_sections, named, neighbours, runs_of
from docloom.functions.text import content_hash


def tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), (F.length(text) / 4).cast("int"))


def _fold(fold, *options):
    """A column function of an array of numbers that gives runs (null: nothing).

    A plan has several, and each has a worker of its own in every task: plain
    functions, whose workers hold a few rows and load neither pandas nor Arrow.
    """
    return F.udf(lambda values: named(None if values is None else fold(values, *options)), RUNS, useArrow=False)


def _ancestors(levels: Column) -> Column:
    @F.arrow_udf("array<array<int>>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array((None if v is None else ancestors(v) for v in (x.as_py() for x in values)), pa.list_(pa.list_(pa.int32())))

    return run(levels)


# --- cutting -----------------------------------------------------------------


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _joined(parts: Column, run: Column, joint: str) -> Column:
    return F.array_join(F.slice(parts, run["first"] + 1, run["last"] - run["first"] + 1), joint)


def _windows(text: Column, limit: int) -> Column:
    """A text in pieces of 4 * limit characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(4 * limit)), lambda i: F.substring(text, i + 1, F.lit(4 * limit)))


def _exploded(rows: DataFrame, pieces: Column, level: str, flag: str) -> DataFrame:
    """Rows (_text, ...) with a row a piece (content, more) in place of the text; `level` is its place."""
    others = [c for c in rows.columns if c not in ("_text", flag)]
    return rows.select(*others, F.posexplode(pieces).alias(level, "_p")).select(*others, level, F.col("_p.content").alias("_text"), F.col("_p.more").alias(flag))


def _cut(rows: DataFrame, long: Column, limit: int, overlap: int, seed: Column | None = None, recheck: bool = True) -> DataFrame:
    """Rows (_text) where `long` ones are cut by paragraphs, paragraphs over the limit by sentences, sentences over it by length; _a, _b, _c are the places.

    With `recheck` a last chunk that its overlap brought over the limit is cut by
    sentences too. `seed` is what all chunks but the first count more.
    """
    piece = lambda content, more: F.struct(content.alias("content"), more.alias("more"))
    one = lambda text: F.array(piece(text, F.lit(False)))
    rows = rows.withColumn("_long", long).withColumn("_parts", F.when(F.col("_long"), F.split("_text", r"\n\n+")))
    sizes = F.transform("_parts", tokens)
    if seed is None:
        rows = rows.withColumn("_runs", _fold(runs_of, limit, overlap, 0, STRICT)(sizes))
    else:
        rows = rows.withColumn("_runs", _seeded(limit, overlap)(sizes, seed))
    last = F.size("_runs") - 1

    def paragraph(run: Column, i: Column) -> Column:
        text = _joined(F.col("_parts"), run, "\n\n")
        over = (i == last) & (tokens(text) > limit) if recheck else F.lit(False)
        return piece(text, (run["named"] == 1) | over)

    rows = _exploded(rows, F.when(F.col("_long"), F.transform("_runs", paragraph)).otherwise(one(F.col("_text"))), "_a", "_more").drop("_long", "_parts", "_runs")
    # Sentences of what is still too long; a text of one sentence is cut by its length.
    rows = rows.withColumn("_parts", F.when(F.col("_more"), F.split("_text", r"(?<=[.?!])\s+")))
    rows = rows.withColumn("_runs", _fold(runs_of, limit, overlap, 0, LOOSE)(F.when(F.size("_parts") > 1, F.transform("_parts", tokens))))
    sentences = F.transform("_runs", lambda run: piece(_joined(F.col("_parts"), run, " "), run["named"] == 1))
    sentences = F.when(~F.col("_more"), one(F.col("_text"))).when(F.size("_parts") > 1, sentences).otherwise(F.array(piece(F.col("_text"), F.lit(True))))
    rows = _exploded(rows, sentences, "_b", "_more").drop("_parts", "_runs")
    pieces = F.when(F.col("_more"), F.transform(_windows(F.col("_text"), limit), lambda w: piece(w, F.lit(False)))).otherwise(one(F.col("_text")))
    return _exploded(rows, pieces, "_c", "_more").drop("_more")


def _seeded(limit: int, overlap: int, how: int = STRICT):
    """The fold of `runs_of` with a seed for each row."""
    return F.udf(lambda values, seed: named(None if values is None else runs_of(values, limit, overlap, seed, how)), RUNS, useArrow=False)


def _numbered(rows: DataFrame, others: list[str], row: str = "_row") -> DataFrame:
    """Chunks of each row in order, with their place, size and hash."""
    order = Window.partitionBy(row).orderBy("_s", "_a", "_b", "_c")
    numbered = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    return numbered.select(*others, F.col("_text").alias("content"), F.col("_path").alias("heading_path"), "chunk_index", tokens(F.col("_text")).alias("token_count"), content_hash(F.col("_text")).alias("content_hash"))


def _rows(rows: DataFrame, text: str, name: str, key: str) -> tuple[DataFrame, list[str]]:
    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.col(key).alias("_row"), F.coalesce(F.col(name), F.lit("")).alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_text")), others


def sections(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Rows with _sections: array of path and text of a Markdown text, cut before its headings; `Introduction` before the first."""
    heading = r"#{1,6}[^\S\n][^\n]+"
    pieces = F.split(text, rf"(?<=\n)(?={heading})")
    line = lambda p: F.regexp_extract(p, rf"^({heading})", 1)
    level = lambda p: F.when(line(p) == "", 0).otherwise(F.length(F.regexp_extract(line(p), r"^(#+)", 1)))
    rows = rows.withColumn("_pieces", pieces)
    rows = rows.withColumn("_above", _ancestors(F.transform("_pieces", level)))
    title = lambda p: _stripped(F.regexp_extract(line(p), r"^#+\s+(.+)$", 1))
    path = lambda i: F.array_join(F.transform(F.get("_above", i), lambda at: F.when(at < 0, "").otherwise(title(F.get("_pieces", at)))), " > ")
    told = F.transform("_pieces", lambda p, i: F.struct(F.coalesce(F.nullif(path(i), F.lit("")), F.lit("Introduction")).alias("path"), _stripped(p).alias("text")))
    return rows.withColumn("_sections", F.filter(told, lambda s: s["text"] != "")).drop("_pieces", "_above")


def document_chunks(rows: DataFrame, text: str, title: str, key: str, least: int = 200, limit: int = 1500, overlap: int = 100) -> DataFrame:
    """Chunks of Markdown texts: sections, small ones merged forward while they fit, large ones cut, the title before their path.

    Result: the row's other columns, content, heading_path, chunk_index,
    token_count, content_hash. `key` tells the rows apart. Null and blank texts have
    no chunks.
    """
    given, others = _rows(rows, text, title, key)
    cut = sections(given)
    cut = cut.withColumn("_runs", _fold(merged_sections, least, limit)(F.transform("_sections", lambda s: F.length(s["text"]))))
    run = F.col("_run")
    each = cut.select(*others, "_row", "_name", "_sections", F.posexplode("_runs").alias("_s", "_run"))
    path = F.get("_sections", run["named"])["path"]
    full = F.when((F.col("_name") == "") | path.startswith(F.col("_name")), path).otherwise(F.concat("_name", F.lit(" > "), path))
    each = each.select(*others, "_row", "_s", full.alias("_path"), _joined(F.transform("_sections", lambda s: s["text"]), run, "\n\n").alias("_text"))
    return _numbered(_cut(each, tokens(F.col("_text")) > limit, limit, overlap), others)


def statute_chunks(rows: DataFrame, text: str, citation: str, key: str, limit: int = 1500, overlap: int = 100) -> DataFrame:
    """Sections of laws whole, or packed by their subdivisions `(a)`, the citation before all chunks but the first; without subdivisions cut by paragraphs.

    heading_path is the citation. Blank texts have no chunks.
    """
    given, others = _rows(rows, text, citation, key)
    given = given.where(_stripped(F.col("_text")) != "")
    whole = tokens(F.col("_text")) <= limit
    marked = F.col("_text").rlike(r"(?:^|\n)\([a-z]\)\s")
    head = F.concat(F.lit("["), "_name", F.lit("]\n\n"))
    pieces = F.split("_text", r"(?<=\n)(?=\([a-z]\)\s)")
    lead = ~F.get(pieces, F.lit(0)).rlike(r"^\([a-z]\)\s")
    stripped = F.filter(F.transform(pieces, lambda p, i: F.when((i == 0) & lead, _stripped(p)).otherwise(p)), lambda p: p != "")
    given = given.withColumn("_by", marked & ~whole).withColumn("_parts", F.when(F.col("_by"), stripped).otherwise(F.array("_text")))
    given = given.withColumn("_runs", _seeded(limit, 0, NEVER)(F.transform("_parts", tokens), tokens(head)))
    each = given.select(*others, "_row", "_name", "_by", "_parts", F.posexplode("_runs").alias("_s", "_run"))
    told = _joined(F.col("_parts"), F.col("_run"), "\n\n")
    told = F.when(F.col("_by") & (F.col("_s") > 0), F.concat(F.concat(F.lit("["), "_name", F.lit("]\n\n")), told)).otherwise(told)
    each = each.select(*others, "_row", "_s", "_by", F.col("_name").alias("_path"), told.alias("_text"))
    return _numbered(_cut(each, ~F.col("_by") & (tokens(F.col("_text")) > limit), limit, overlap), others)


def opinion_chunks(rows: DataFrame, text: str, citation: str, key: str, limit: int = 1500, overlap: int = 100) -> DataFrame:
    """Opinions whole, or packed by paragraphs with overlap, the citation before all chunks but the first; heading_path is the citation."""
    given, others = _rows(rows, text, citation, key)
    given = given.where(_stripped(F.col("_text")) != "").select(*others, "_row", F.lit(0).alias("_s"), F.col("_name").alias("_path"), "_text")
    head = F.concat(F.lit("["), "_path", F.lit("]\n\n"))
    cut = _cut(given, tokens(F.col("_text")) > limit, limit, overlap, tokens(head), recheck=False)
    later = (F.col("_a") > 0) | (F.col("_b") > 0) | (F.col("_c") > 0)
    return _numbered(cut.withColumn("_text", F.when(later, F.concat(head, "_text")).otherwise(F.col("_text"))), others)


def page_chunks(rows: DataFrame, text: str, name: str, key: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Form-feed pages, small neighbours merged, with page ranges as headings; blank pages still count."""
    given, others = _rows(rows, text, name, key)
    pages = F.filter(F.transform(F.split("_text", "\f"), lambda p, i: F.struct((i + 1).alias("number"), _stripped(p).alias("text"))), lambda p: p["text"] != "")
    given = given.withColumn("_pages", pages)
    given = given.withColumn("_runs", _fold(neighbours, limit)(F.transform("_pages", lambda p: F.length(p["text"]))))
    each = given.select(*others, "_row", "_name", "_pages", F.posexplode("_runs").alias("_s", "_run"))
    number = lambda at: F.get("_pages", F.col("_run")[at])["number"]
    pages_of = F.when(number("first") == number("last"), F.concat(F.lit(" > Page "), number("first").cast("string"))).otherwise(F.concat(F.lit(" > Pages "), number("first").cast("string"), F.lit("-"), number("last").cast("string")))
    each = each.select(*others, "_row", "_s", F.concat("_name", pages_of).alias("_path"), _joined(F.transform("_pages", lambda p: p["text"]), F.col("_run"), "\n\n").alias("_text"))
    return _numbered(_cut(each, tokens(F.col("_text")) > limit, limit, overlap), others)


def _divided(rows: DataFrame, parts: Column, path: Column, others: list[str], limit: int, overlap: int) -> DataFrame:
    """Parts of texts (_part at _s of _n), blank ones left out, long ones cut."""
    each = rows.withColumn("_all", parts).select(*others, "_row", "_name", F.size("_all").alias("_n"), F.posexplode("_all").alias("_s", "_part")).where(_stripped(F.col("_part")) != "")
    each = each.select(*others, "_row", "_s", path.alias("_path"), _stripped(F.col("_part")).alias("_text"))
    return _numbered(_cut(each, tokens(F.col("_text")) > limit, limit, overlap), others)


def sheet_chunks(rows: DataFrame, text: str, name: str, key: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """`## ` sheets, and what stands before the first."""
    given, others = _rows(rows, text, name, key)
    sheet = _stripped(F.regexp_extract("_part", r"^## (.+)", 1))
    path = F.when(F.col("_part").rlike(r"^## ."), F.concat("_name", F.lit(" > "), sheet)).otherwise(F.col("_name"))
    return _divided(given, F.split("_text", r"(?<=\n)(?=## )"), path, others, limit, overlap)


def message_chunks(rows: DataFrame, text: str, name: str, key: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """A chunk or more for each message between `---` lines; their numbers count blank messages too."""
    given, others = _rows(rows, text, name, key)
    path = F.when(F.col("_n") > 1, F.concat("_name", F.lit(" > Message "), (F.col("_s") + 1).cast("string"))).otherwise(F.col("_name"))
    return _divided(given, F.split("_text", "\n---\n"), path, others, limit, overlap)


def plain_chunks(rows: DataFrame, text: str, name: str, key: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Other texts whole, or cut by paragraphs; heading_path is the name."""
    given, others = _rows(rows, text, name, key)
    given = given.where(_stripped(F.col("_text")) != "").select(*others, "_row", F.lit(0).alias("_s"), F.col("_name").alias("_path"), "_text")
    return _numbered(_cut(given, tokens(F.col("_text")) > limit, limit, overlap), others)


#: How each kind of case file is cut; others are plain.
BY_KIND = {"pdf": page_chunks, "xlsx": sheet_chunks, "csv": sheet_chunks, "tsv": sheet_chunks, "eml": message_chunks, "mbox": message_chunks, "msg": message_chunks}


def file_chunks(rows: DataFrame, text: str, name: str, kind: str, key: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of case files, each kind in its own way."""
    ways: dict = {}
    for k, cut in BY_KIND.items():
        ways.setdefault(cut, []).append(k)
    out = plain_chunks(rows.where(F.col(kind).isNull() | ~F.col(kind).isin(*BY_KIND)), text, name, key, limit, overlap)
    for cut, kinds in ways.items():
        out = out.unionByName(cut(rows.where(F.col(kind).isin(*kinds)), text, name, key, limit, overlap))
    return out
