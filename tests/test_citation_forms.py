"""Forms of citations: what each has, where it stands, what it goes back to."""

import pytest

from docloom.operators import citation_forms


def found(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, body string")
    out = citation_forms.grouped(citation_forms.forms(rows, "body", **options), "doc").orderBy("doc", "position").collect()
    return out


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Yanowitz v. L'Oreal USA, Inc. (2005) 36 Cal.4th 1028", ("case", "36", "Cal. 4th", "1028", "2005", "Yanowitz", "L'Oreal USA, Inc.", True)),
        ("Harris v. City of Santa Monica (2013) 56 Cal.4th 203", ("case", "56", "Cal. 4th", "203", "2013", "Harris", "City of Santa Monica", True)),
        ("Smith v. Jones (2023) 95 Cal.App.5th 123", ("case", "95", "Cal. App. 5th", "123", "2023", "Smith", "Jones", True)),
        ("See Doe v. Roe, 150 Cal.Rptr.3d 456 (2022)", ("case", "150", "Cal. Rptr. 3d", "456", "2022", "Doe", "Roe", True)),
        ("Bush v. Gore, 531 U.S. 98 (2000)", ("case", "531", "U.S.", "98", "2000", "Bush", "Gore", False)),
        ("Jones v. County of Los Angeles, 300 F.Supp.3d 500 (C.D. Cal. 2018)", ("case", "300", "F. Supp. 3d", "500", "2018", "Jones", "County of Los Angeles", False)),
        ("ABC v. XYZ, 100 P.3d 500 (Cal. 2024)", ("case", "100", "P.3d", "500", "2024", "ABC", "XYZ", True)),
        ("the court in Smith v. Widget Corp., 450 F.3d 1200 (9th Cir. 2006) held", ("case", "450", "F.3d", "1200", "2006", "Smith", "Widget Corp.", False)),
        ("Williams v. State (1985) 170 Cal. App. 3d 250", ("case", "170", "Cal. App. 3d", "250", "1985", "Williams", "State", True)),
    ],
)
def test_full_cases(spark, text, expected):
    (r,) = found(spark, text)
    assert (r.citation_type, r.volume, r.reporter, r.page, r.year, r.plaintiff, r.defendant, r.is_state) == expected
    assert text[r.start : r.end] == r.cited_text


@pytest.mark.parametrize("text, reporter, section", [("Cal. Gov. Code § 12940", "Cal. Gov. Code", "12940"), ("Cal. Lab. Code § 1102.5", "Cal. Lab. Code", "1102.5"), ("Bus. & Prof. Code §17200", "Cal. Bus. & Prof. Code", "17200"), ("Cal. Civ. Proc. Code §§ 1021.5", "Cal. Civ. Proc. Code", "1021.5"), ("Cal. Unemp. Ins. Code § 1256(a)(2)", "Cal. Unemp. Ins. Code", "1256(a)(2)")])
def test_statutes(spark, text, reporter, section):
    (r,) = found(spark, f"under {text}, x")
    assert (r.citation_type, r.reporter, r.section, r.is_state) == ("statute", reporter, section, True)


def test_forms_that_go_back(spark):
    rows = found(
        spark,
        "In Tameny v. Atlantic Richfield Co. (1980) 27 Cal.3d 167, the court held. Later courts followed Tameny, supra, at 170. Id. at 171. See Bush v. Gore, 531 U.S. 98, 101 (2000). Ibid. Again 27 Cal.3d at 172; and Lab. Code § 98. Id. Nobody, supra. id. at 3",
    )
    assert [(r.citation_type, r.antecedent is not None and rows[r.antecedent].cited_text, r.pin_cite, r.is_state) for r in rows] == [
        ("case", "27 Cal.3d 167", None, True),
        ("supra", "27 Cal.3d 167", "170", True),
        ("id", "27 Cal.3d 167", "171", True),
        ("case", "531 U.S. 98", "101", False),
        ("id", "531 U.S. 98", None, False),
        ("short_case", "27 Cal.3d 167", "172", True),
        ("statute", "Lab. Code § 98", None, True),
        ("id", "Lab. Code § 98", None, True),
        ("supra", False, None, False),
        ("id", False, "3", False),
    ]


def test_numbers_of_many_digits(spark):
    rows = found(spark, "In Doe v. Roe (1975) 15 Cal.3d 899950, 899952-899953, they held. Later Doe, supra, at 1000001. Id. at 899952. See 15 Cal.3d at 899952; Doe, supra, 15 Cal.3d at 899954. 20250 U.S. 7")
    assert [(r.citation_type, r.cited_text, r.volume, r.page, r.pin_cite, r.antecedent) for r in rows] == [
        ("case", "15 Cal.3d 899950", "15", "899950", "899952-899953", 0),
        ("supra", "Doe, supra, at 1000001", None, None, "1000001", 0),
        ("id", "Id. at 899952", None, None, "899952", 0),
        ("short_case", "15 Cal.3d at 899952", "15", None, "899952", 0),
        ("supra", "Doe, supra, 15 Cal.3d at 899954", "15", None, "899954", 0),
        ("case", "20250 U.S. 7", "20250", "7", None, 5),
    ]


def test_string_cites_spaces_and_places(spark):
    text = "See  36 Cal.4th\n1028; 56 Cal.4th 203;\t27 Cal.3d 167. É 😀 531 U.S. 98"
    clean = " ".join(text.split())
    rows = found(spark, text)
    assert [(r.volume, r.page) for r in rows] == [("36", "1028"), ("56", "203"), ("27", "167"), ("531", "98")]
    assert all(clean[r.start : r.end] == r.cited_text for r in rows)


def test_ambiguous_reporters(spark):
    text = "Roe v. Poe, 5 How. 12 (1850). Doe v. Moe, 6 How. 13 (1843). Foe v. Loe, 7 How. 14."
    assert [(r.volume, r.reporter) for r in found(spark, text)] == [("5", "How. (U.S.)")]
    assert [(r.volume, r.reporter) for r in found(spark, text, remove_ambiguous=False)] == [("5", "How. (U.S.)"), ("6", "How."), ("7", "How.")]


def test_nothing_to_find(spark):
    assert found(spark, "", "  \n\t ", None, "No citations here, only 12 Cal. and § 5.", "the idea, madid. x") == []


def test_filters(spark):
    rows = spark.createDataFrame([(1, "Doe v. Roe (1975) 15 Cal.3d 100. Bush v. Gore, 531 U.S. 98 (2000). Pen. Code § 5. Id. Bush, supra.")], "doc long, body string")
    out = citation_forms.grouped(citation_forms.forms(rows, "body"), "doc")
    texts = lambda df: [r.cited_text for r in df.orderBy("position").collect()]
    assert texts(citation_forms.cases_only(out)) == ["15 Cal.3d 100", "531 U.S. 98", "Id.", "Bush, supra"]
    assert texts(citation_forms.statutes_only(out)) == ["Pen. Code § 5"]
    assert texts(citation_forms.of_the_state(out)) == ["15 Cal.3d 100", "Pen. Code § 5", "Id."]


def test_long_runs_of_names_need_no_deep_stack(spark):
    run = "Aa of " * 3000
    out = found(spark, run + "; In Doe v. State (1999) 5 U.S. 10.", run + "Doe v. State (1999) 5 U.S. 10.")
    assert [(r.plaintiff[-3:], r.defendant, r.year) for r in out] == [("Doe", "State", "1999")] * 2
    assert [len(r.plaintiff) for r in out] == [3, len(run) + 3]
