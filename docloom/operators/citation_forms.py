"""All forms of citations with their places: full and short cases, supra, id. and statutes, in SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed import STATE_REPORTERS

#: Editions that an abbreviation may mean, with the years of their volumes. One name and no years: no doubt.
EDITIONS: dict[str, tuple[tuple[str, int, int], ...]] = {
    **{name: ((name, 1, 9999),) for name in (*STATE_REPORTERS, "U.S.", "S. Ct.", "L. Ed.", "L. Ed. 2d", "F.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "P.", "P.2d", "P.3d")},
    "How.": (("How. (U.S.)", 1843, 1860), ("How. (Miss.)", 1834, 1843)),
    "Black": (("Black (U.S.)", 1861, 1862), ("Blackf. (Ind.)", 1817, 1847)),
    "Cranch": (("Cranch (U.S.)", 1801, 1815), ("Cranch (D.C.)", 1801, 1840)),
}
#: Subjects of codes, as a statute's citation names them.
SUBJECTS = ("Bus. & Prof.", "Civ. Proc.", "Civ.", "Educ.", "Fam.", "Fin.", "Gov.", "Health & Safety", "Ins.", "Lab.", "Pen.", "Prob.", "Rev. & Tax.", "Unemp. Ins.", "Veh.", "Wat.", "Welf. & Inst.")


def _loose(name: str) -> str:
    """A name as a pattern, with or without the spaces after its points."""
    return re.escape(name).replace(r"\ ", " ").replace(r"\. ", r"\. ?").replace(r"\&", "&")


_REPORTER = "|".join(_loose(n) for n in sorted(EDITIONS, key=lambda n: (-len(n), n)))
_SUBJECT = "|".join(_loose(n) for n in sorted(SUBJECTS, key=lambda n: (-len(n), n)))
_SECTION = r"\d+(?:\.\d+)?(?:\([a-z0-9]+\))*"
_NAME = r"[A-Z][\w'’&-]*"
#: Words that lead to a case and are no part of its name.
_LEAD = "As|In|See|The|Under|But|Cf|Compare|Accord|Later|And|Also|Court"
#: The tokens, in the order in which they are tried at a place. Volumes, pages and pins have as many digits as they like.
SHORT = rf"\b\d+ (?:{_REPORTER}),? at \d+\b"
FULL = rf"\b\d+ (?:{_REPORTER}) \d+\b"
STATUTE = rf"\b(?:Cal\. ?)?(?:{_SUBJECT}) Code §§? ?{_SECTION}"
SUPRA = rf"\b(?!(?:{_LEAD})\b){_NAME}(?: {_NAME}){{0,3}}, supra(?:,? at \d+|, \d+ (?:{_REPORTER}) at \d+)?"
ID = r"\b(?:[Ii]d\.|[Ii]bid\.)(?:,? at \d+\b)?"
#: Every form begins with one of a few characters; most places of a text end there.
TOKEN = rf"(?=[A-Z0-9i])(?:{'|'.join((SHORT, FULL, STATUTE, SUPRA, ID))})"

#: What stands around a full citation: names and year before it, pin and court and year after it. Runs of words are
#: possessive: no shorter run could fit, and a run that could be given back takes the stack a level deeper a word.
_BEFORE = rf"((?:{_NAME}\.?,?|of|the|and|for|&|Co\.|Inc\.)(?: (?:{_NAME}\.?,?|of|the|and|for|&|Co\.|Inc\.))*+) v\. ([A-Z][^;()]*?),?(?: \((?:[^()]* )?(\d{{4}})\))? $"
#: The end of a text, read backwards, that _BEFORE and _YEAR_BEFORE can reach: neither has ; ( or ) but in one last pair.
_REACH = r"^[\u0085\u2028\u2029]? (?:\)[^()]*\()?[^;()]*"
_YEAR_BEFORE = r"\((?:[^()]* )?(\d{4})\) $"
_AFTER = r"^(?:, (\d+(?:-\d+)?))?(?: \(((?:[^()]*[^() ])?) ?(\d{4})\))?"
_LEADS = rf"^(?:(?:{_LEAD}|also|noted|court)\.? )++"


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r\\u00A0]+", " ")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _squeezed(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def forms(rows: DataFrame, text: str, remove_ambiguous: bool = True) -> DataFrame:
    """One row a citation of each text, in order, with the other columns of `rows`.

    position (0, 1... among the text's tokens), citation_type (case, short_case, supra, id,
    statute), cited_text, start and end in code points of the text with runs of
    white space made one space; volume, reporter (its full name), page, pin_cite,
    year, court, plaintiff and defendant of cases, plaintiff (the name given) and
    volume of supra, section of statutes; is_state of full, short and statute
    forms. The text is cut by one pattern of all tokens: at a place the first form
    that fits counts, and tokens don't overlap. With remove_ambiguous, a reporter
    that may be several ones in the citation's year is dropped. Null and empty texts
    have no citations. Columns named like the result's are replaced.
    """
    names = ["position", "citation_type", "cited_text", "start", "end", "volume", "reporter", "page", "pin_cite", "year", "court", "plaintiff", "defendant", "section", "is_state"]
    kept = [c for c in rows.columns if c != text and c not in names]
    cut = rows.select(*kept, _clean(F.col(text)).alias("_text")).where(F.col("_text").rlike(TOKEN))
    cut = cut.select(*kept, F.regexp_extract_all("_text", F.lit(f"({TOKEN})"), F.lit(1)).alias("_found"), F.split("_text", TOKEN, -1).alias("_gaps"))
    # The place of a token: the lengths of all gaps up to it and of all tokens before it.
    lengths = F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda gap, token: F.struct(F.length(gap).alias("gap"), F.length(token).alias("token")))
    start = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.when(F.size(acc) == 0, n["gap"]).otherwise(F.element_at(acc, -1) + n["gap"]), F.when(F.size(acc) == 0, n["gap"] + n["token"]).otherwise(F.element_at(acc, -1) + n["gap"] + n["token"]))))
    each = cut.select(*kept, start.alias("_at"), "_found", "_gaps").select(*kept, F.posexplode("_found").alias("_i", "cited_text"), "_at", "_gaps")
    i = F.col("_i")
    each = each.select(*kept, "_i", "cited_text", F.element_at("_at", 2 * i + 1).alias("start"), F.element_at("_at", 2 * i + 2).alias("end"), F.reverse(F.regexp_extract(F.reverse(F.element_at("_gaps", i + 1)), _REACH, 0)).alias("_before"), F.element_at("_gaps", i + 2).alias("_after"))
    own = F.col("cited_text")
    kind = F.when(own.contains(", supra"), "supra").when(own.rlike("§"), "statute").when(own.rlike(r"^[Ii](?:b?i)?d\."), "id").when(own.rlike(rf"^{SHORT}$"), "short_case").otherwise("case")
    each = each.withColumn("citation_type", kind)
    case, short, supra, statute, full_or_short = (F.col("citation_type") == "case", F.col("citation_type") == "short_case", F.col("citation_type") == "supra", F.col("citation_type") == "statute", F.col("citation_type").isin("case", "short_case"))
    raw = F.when(full_or_short, _part(own, rf"^\d+ ({_REPORTER}),? (?:at )?\d+$", 1))
    code = F.when(statute, F.concat(F.lit("Cal. "), _part(own, rf"({_SUBJECT}) Code", 1), F.lit(" Code")))
    year = F.when(case, F.coalesce(_part(F.col("_after"), _AFTER, 3), _part(F.col("_before"), _YEAR_BEFORE, 1)))
    court = F.when(case, _part(F.col("_after"), _AFTER, 2))
    each = each.withColumns({"_raw": _squeezed(raw), "year": year, "court": court})
    # Editions that the abbreviation may be, in a citation of that year.
    known = F.create_map(*[x for name, several in EDITIONS.items() for x in (F.lit(name.replace(" ", "")), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("since"), F.lit(b).alias("until")) for n, a, b in several]))])
    of = F.try_element_at(known, F.col("_raw"))
    when = F.col("year").cast("int")
    fitting = F.when(F.size(of) == 1, of).otherwise(F.filter(of, lambda e: when.isNotNull() & (e["since"] <= when) & (when <= e["until"])))
    each = each.withColumn("_editions", fitting)
    clear = ~full_or_short | (F.size("_editions") == 1)
    reporter = F.when(full_or_short & clear, F.element_at("_editions", 1)["name"]).otherwise(F.coalesce(code, F.when(full_or_short, raw)))
    each = each.withColumn("reporter", reporter)
    each = each.where(clear) if remove_ambiguous else each
    lead = F.regexp_replace(_part(F.col("_before"), _BEFORE, 1), _LEADS, "")
    state_court = F.lower("court").startswith("cal") | F.lower("court").startswith("ca.")
    each = each.withColumns({
        "volume": F.when(full_or_short, _part(own, r"^(\d+) ", 1)).when(supra, _part(own, r", supra, (\d+) ", 1)),
        "page": F.when(case, _part(own, r" (\d+)$", 1)),
        "pin_cite": F.when(case, _part(F.col("_after"), _AFTER, 1)).when(~statute, _part(own, r"(?:^|,| )at (\d+)$", 1)),
        "plaintiff": F.when(case, lead).when(supra, F.regexp_replace(_part(own, r"^(.*?), supra", 1), _LEADS, "")),
        "defendant": F.when(case, F.regexp_replace(_part(F.col("_before"), _BEFORE, 2), r",$", "")),
        "section": F.when(statute, _part(own, rf"({_SECTION})$", 1)),
        "is_state": F.when(statute, F.lit(True)).when(full_or_short, F.col("reporter").isin(*STATE_REPORTERS) | F.coalesce(F.when(case, state_court), F.lit(False))).otherwise(F.lit(False)),
    })
    return each.withColumn("position", i).select(*kept, *names)


def grouped(found: DataFrame, by: str) -> DataFrame:
    """`forms` with antecedent, the position of the full citation that each one goes back to, null for none; is_state passes on.

    A full case or a statute is its own. A short case goes to the last full case of its volume
    and reporter, supra to the last full case that has the name given in a party's
    name, id. to whatever the citation before it goes back to.
    """
    w = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    full = F.struct("position", "volume", "reporter", "plaintiff", "defendant", "is_state")
    cases = F.collect_list(F.when(F.col("citation_type") == "case", full)).over(w)
    last = lambda fits: F.try_element_at(F.filter("_cases", fits), F.lit(-1))
    name = F.col("plaintiff")
    in_party = lambda c: F.coalesce(c["plaintiff"].contains(name), F.lit(False)) | F.coalesce(c["defendant"].contains(name), F.lit(False))
    same = lambda c: (c["volume"] == F.col("volume")) & (c["reporter"] == F.col("reporter"))
    own = F.struct("position", "volume", "reporter", "plaintiff", "defendant", "is_state")
    to = F.when(F.col("citation_type").isin("case", "statute"), own).when(F.col("citation_type") == "short_case", last(same)).when(F.col("citation_type") == "supra", last(in_party))
    marked = found.withColumn("_cases", cases).withColumn("_to", to)
    # An id. takes what the last citation that is none goes back to, found or not.
    before = F.last(F.when(F.col("citation_type") != "id", F.struct(F.col("_to").alias("to"))), True).over(w)
    marked = marked.withColumn("_to", F.when(F.col("citation_type") == "id", before["to"]).otherwise(F.col("_to")))
    return marked.withColumns({"antecedent": F.col("_to.position"), "is_state": F.coalesce(F.col("_to.is_state"), F.col("is_state"))}).drop("_cases", "_to")


def cases_only(found: DataFrame) -> DataFrame:
    return found.where("citation_type != 'statute'")


def statutes_only(found: DataFrame) -> DataFrame:
    return found.where("citation_type = 'statute'")


def of_the_state(found: DataFrame) -> DataFrame:
    """The state's own citations: by reporter, court, code, or the citation that they go back to."""
    return found.where("is_state")
