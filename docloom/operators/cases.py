"""Cases and what hangs on them: sections to ask, titles, chunks of files, sessions, fetches, page confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.text import first_match


def suggested_sections(sections: Column, plaintiff: Column, has_requests: Column, is_entity: Column) -> Column:
    """Sections of the general form to ask, sorted as strings: those of the claims, with the ones that always belong.

    A defendant does not ask what only plaintiffs ask; entities get their own
    sections, persons theirs; vehicles never. A null array counts as empty.
    """
    texts = lambda *v: F.array(*map(F.lit, v))
    base = F.array_union(F.coalesce(sections, F.array().cast("array<string>")), texts("1.1", "15.1"))
    base = F.when(plaintiff, base).otherwise(F.array_except(base, texts(*fixed.PLAINTIFF_ONLY)))
    base = F.array_union(base, F.when(is_entity, texts(*fixed.ENTITY_SECTIONS)).otherwise(texts("2.1")))
    base = F.when(has_requests, F.array_union(base, texts("17.1"))).otherwise(base)
    return F.array_sort(F.array_except(base, texts(*fixed.VEHICLE_SECTIONS)))


def set_label(number: Column) -> Column:
    """The number of a set as a word up to ten, in digits beyond."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, fixed.SET_WORDS)), F.when(number > 0, number.cast("int")).otherwise(1_000)), number.cast("string"))


def party_block(names: Column, does: Column | None = None) -> Column:
    """Names of a side, a line each; with `does`, the unnamed ones after them."""
    block = F.array_join(names, ",\n")
    return block if does is None else F.when(does, F.concat(block, F.lit(";\nDoes 1 through 50, inclusive"))).otherwise(block)


def document_title(plaintiffs: Column, defendants: Column, by_plaintiff: Column, label: Column, number: Column) -> Column:
    """The title line: who asks whom for what, and the set. A side without names goes by its designation."""
    name = lambda names, side: F.upper(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(side)))
    p, d = name(plaintiffs, "Plaintiff"), name(defendants, "Defendant")
    line = lambda a, x, b, y: F.concat(F.lit(a + " "), x, F.lit("'S "), label, F.lit(f" TO {b} "), y, F.lit(", Set "), set_label(number))
    return F.when(by_plaintiff, line("PLAINTIFF", p, "DEFENDANT", d)).otherwise(line("DEFENDANT", d, "PLAINTIFF", p))


def chunks_of(chunks: DataFrame, case_id=None, file_id=None) -> DataFrame:
    """Active chunks of a file, else of a case, else of all, in the order of case, file and place."""
    some = chunks.where("is_active")
    if file_id is not None:
        some = some.where(F.col("file_id") == file_id)
    elif case_id is not None:
        some = some.where(F.col("case_id") == case_id)
    return some.orderBy("case_id", "file_id", "chunk_index")


def without_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """`chunks` less all those of the given files, inactive ones too."""
    return chunks.join(files.select("file_id").distinct(), "file_id", "left_anti")


def unexpired(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that are neither revoked nor past their end; null counts as neither."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False)) | F.coalesce(F.col("is_revoked"), F.lit(False))
    return sessions.where(~gone)


def broken_off(fetches: DataFrame, by: str, failed: str, least: int = 6, most: float = 0.5) -> DataFrame:
    """by, n, n_failed, is_broken: sources of at least `least` requests of which more than the share `most` failed."""
    each = fetches.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(failed)).alias("n_failed"))
    return each.withColumn("is_broken", (F.col("n") >= least) & (F.col("n_failed") / F.col("n") > most))


def page_confidence(words: DataFrame, by: str, page: str, word: str, value: str) -> DataFrame:
    """by, confidence (0 to 1): mean over pages of the mean over words; separators and blank words don't count, a page without words is 0."""
    counts = (F.col(value) > 0) & (F.trim(F.col(word)) != "")
    pages = words.groupBy(by, page).agg(F.coalesce(F.avg(F.when(counts, F.col(value))) / 100, F.lit(0.0)).alias("_c"))
    return pages.groupBy(by).agg(F.avg("_c").alias("confidence"))


def id_of_url(url: Column) -> Column:
    """The number at the end of a resource's address; null without one."""
    return F.nullif(F.regexp_extract(url, r"/(\d+)/?$", 1), F.lit("")).cast("long")


def category_with_default(configured: Column, of_url: Column, general: str = "agency_guidance") -> Column:
    """The configured category, but the url's if that says FAQ or fact sheet or none beyond the general one is configured."""
    return F.when((configured == general) | of_url.isin("faq", "fact_sheet"), of_url).otherwise(configured)


def of_tier(sources: DataFrame, tier: str | None, category: str = "content_category") -> DataFrame:
    """Sources whose category belongs to the tier; all without a tier, none for an unknown one."""
    return sources if tier is None else sources.where(F.col(category).isin(*fixed.TIER_CATEGORIES.get(tier, ())))


def intake_query(status: Column, government: Column, issues: Column, clauses: dict[str, str]) -> Column:
    """What a person asks, from issues (issue_type, confidence): high ones before medium ones before others, in their order."""
    number = lambda i: F.when(i["confidence"] == "high", 0).when(i["confidence"] == "medium", 1).otherwise(2)
    known = F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv])
    of_rank = lambda k: F.filter(issues, lambda i: number(i) == k)
    ranked = F.concat(*map(of_rank, range(3)))
    said = F.array_compact(F.transform(ranked, lambda i: F.try_element_at(known, i["issue_type"])))
    parts = [F.lit("I am a California employee"), first_match([(status == "terminated", "who was recently terminated"), (status == "quit", "who recently quit")], "who is still employed")]
    parts += [F.when(government, F.lit("working for a government employer")), F.when(F.size(said) > 0, F.concat(F.lit(". Specifically, "), F.array_join(said, "; ")))]
    return F.concat(F.concat_ws(" ", *parts), F.lit(". What are my rights under California law and what steps should I take?"))


def joined_defaults(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's url, language and source; `""`, `en` and 0 where there is none."""
    docs = documents.select(F.col("id").alias("document_id"), "source_url", "language", "source_id")
    return chunks.join(docs, "document_id", "left").fillna({"source_url": "", "language": "en", "source_id": 0})


def directed_sections(cases: DataFrame, form: DataFrame, key: str, always: tuple[str, ...] = ("200.1", "216.1"), with_requests: str = "217.1") -> DataFrame:
    """key, sections of the employment form to ask, sorted: those of the claims that are directed to the other side.

    cases has key, sections (array, null as empty), plaintiff and has_requests; form has
    section and directed_to (employer, employee or both). A plaintiff asks what is
    directed to the employer, a defendant what is directed to the employee; some
    sections are always asked, one with requests for admission only. Sections that
    the form does not have are left out. Keys must be unique.
    """
    asked = cases.select(key, "plaintiff", "has_requests", F.explode_outer("sections").alias("section")).join(form, "section", "left")
    fits = (F.col("directed_to") == "both") | (F.col("directed_to") == F.when(F.col("plaintiff"), "employer").otherwise("employee"))
    # Cases come through with their sections, so nothing is made distinct or joined again.
    own = asked.groupBy(key, "has_requests").agg(F.collect_set(F.when(fits, F.col("section"))).alias("_own"))
    base = F.array_union("_own", F.array(*map(F.lit, always)))
    every = F.when(F.col("has_requests"), F.array_union(base, F.array(F.lit(with_requests)))).otherwise(base)
    return own.select(key, F.array_sort(every).alias("sections"))


def listed(rows: DataFrame, by: str, *order, where: Column | None = None) -> DataFrame:
    """Rows with place, in the order of a list of each group (newest cases, files as uploaded, notes as written)."""
    kept = rows if where is None else rows.where(where)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
