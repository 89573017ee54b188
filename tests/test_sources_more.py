"""Contents pages, level carry, regulations in ranges, cascades, change logs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.operators import cascades, changes, shared
from docloom.operators.cascades import Reference
from docloom.sources import contents


def column(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


@pytest.mark.parametrize(
    "base, href, expected",
    [
        ("http://h.x/a/b?q#f", "c", "http://h.x/a/c"), ("http://h.x/a/b", "../c/./d", "http://h.x/c/d"), ("http://h.x/a/b/", "..", "http://h.x/a/"),
        ("http://h.x", "c", "http://h.x/c"), ("http://h.x/a", "/c?d=../e", "http://h.x/c?d=../e"), ("https://h.x/a", "//o.y/z", "https://o.y/z"),
        ("http://h.x/a?b", "?c", "http://h.x/a?c"), ("http://h.x/a?b#d", "#c", "http://h.x/a?b#c"), ("http://h.x/a", "mailto:me@x", "mailto:me@x"),
        ("http://h.x/a", "https://o/../p", "https://o/p"), ("http://h.x/a/b", "../../../c", "http://h.x/c"), ("http://h.x/a/b", "", "http://h.x/a/b"),
    ],
)
def test_joined_url(spark, base, href, expected):
    assert column(spark, contents.joined_url(F.lit(base), F.lit(href))) == expected


def test_links_of_any_quotes(spark):
    page = """<a href="x&amp;y=1">A <b>b</b></a><A class='k' HREF='/z'>
 c </A><a name=n>no</a><a href=w>d</a><a href="">e</a>"""
    rows = contents.links(spark.createDataFrame([(1, "http://h/p/q", page), (2, "http://h", None)], "id long, url string, html string")).collect()
    assert [(r.id, r.href, r.url, r.label) for r in rows] == [(1, "x&y=1", "http://h/p/x&y=1", "A b"), (1, "/z", "http://h/z", "c"), (1, "w", "http://h/p/w", "d"), (1, "", "http://h/p/q", "e")]


def test_levels_are_reset(spark):
    rng, rows = random.Random(4), []
    for page in range(5):
        for i in range(40):
            rows.append((page, i, rng.choice([*contents.LEVELS, None, "other"]), f"v{i}"))
    expected = []
    for page in range(5):
        now = dict.fromkeys(contents.LEVELS, "")
        for p, i, level, value in rows:
            if p == page:
                if level in now:
                    at = contents.LEVELS.index(level)
                    now = {n: ("" if k > at else value if k == at else now[n]) for k, n in enumerate(contents.LEVELS)}
                expected.append((page, i, *now.values()))
    got = contents.carried_levels(spark.createDataFrame(rows, "page long, i long, level string, value string"), "page", "i")
    assert sorted((r.page, r.i, *[r[n] for n in contents.LEVELS]) for r in got.collect()) == sorted(expected)


def test_page_headings(spark):
    rows = contents.page_headings(spark.createDataFrame([(1, "<h3>DIVISION 2. <i>Pay</i></h3><h6>Part 9</h6><H4 class=c>Chapter 1 &amp; on</H4><h5>Notes</h5>"), (2, None)], "id long, html string"), "id").orderBy("ordinal").collect()
    assert [(r.level, r.value) for r in rows] == [("division", "DIVISION 2. Pay"), ("chapter", "Chapter 1 & on")]


def test_ranges_against_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.choice([None, *range(-50, 400)])) for i in range(200)]
    ranges = [(j, rng.choice([None, *range(-60, 380)]), rng.choice([None, *range(-60, 400)])) for j in range(60)]
    p, r = spark.createDataFrame(points, "i long, at long"), spark.createDataFrame(ranges, "j long, low long, high long")
    joined = contents.in_ranges(p, r, "at", "low", "high", 25)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    expected = sorted((i, j) for i, at in points for j, low, high in ranges if None not in (at, low, high) and low <= at <= high)
    assert sorted((x.i, x.j) for x in joined.collect()) == expected


def test_section_order(spark):
    values = ["11008", "11008.1", "11008.2", "11008.10", "11009", "x", "11008.", None]
    got = [column(spark, contents.section_order(F.lit(v).cast("string"))) for v in values]
    assert got[:5] == sorted(got[:5]) and len(set(got[:5])) == 5 and got[5:] == [None] * 3


# --- cascades ----------------------------------------------------------------

KEYS = {"cases": "id", "files": "id", "chunks": "id", "notes": "id"}
LINKS = [Reference("files", "case_id", "cases"), Reference("chunks", "file_id", "files"), Reference("chunks", "case_id", "cases"), Reference("notes", "case_id", "cases"), Reference("notes", "file_id", "files", "set null")]


@pytest.fixture
def case_tables(spark):
    return {
        "cases": spark.createDataFrame([(1, "open", 5), (2, "open", 5), (3, "archived", 5)], "id long, status string, updated_at long"),
        "files": spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, None)], "id long, case_id long"),
        "chunks": spark.createDataFrame([(100, 10, 1), (200, 20, 2), (201, 21, 2), (300, 30, None)], "id long, file_id long, case_id long"),
        "notes": spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 2, None), (4, 3, 21)], "id long, case_id long, file_id long"),
    }


def ids(df):
    return sorted(r.id for r in df.collect())


def test_deletion_cascades(spark, case_tables):
    gone = lambda table, *keys: {table: spark.createDataFrame([(k,) for k in keys], "key long")}
    out = cascades.deleted(case_tables, KEYS, LINKS, gone("cases", 2, 99))
    assert {t: ids(df) for t, df in out.items()} == {"cases": [1, 3], "files": [10, 30], "chunks": [100, 300], "notes": [1, 4]}
    assert {r.id: r.file_id for r in out["notes"].collect()} == {1: 10, 4: None}
    out = cascades.deleted(case_tables, KEYS, LINKS, gone("files", 10) | gone("notes", 3))
    assert {t: ids(df) for t, df in out.items()} == {"cases": [1, 2, 3], "files": [20, 21, 30], "chunks": [200, 201, 300], "notes": [1, 2, 4]}
    assert {r.id: r.file_id for r in out["notes"].collect()} == {1: None, 2: 20, 4: 21}


def test_archiving_and_errors(spark, case_tables):
    gone = {"cases": spark.createDataFrame([(2,), (3,)], "key long")}
    out = cascades.archived(case_tables, KEYS, LINKS, gone, F.lit(9))
    assert sorted(tuple(r) for r in out["cases"].collect()) == [(1, "open", 5), (2, "archived", 9), (3, "archived", 5)]
    assert ids(out["files"]) == ids(case_tables["files"])
    with pytest.raises(ValueError, match="round"):
        cascades.in_order(["a", "b", "c"], [Reference("a", "x", "b"), Reference("b", "x", "a")])
    assert cascades.in_order(["c", "b", "a"], [Reference("a", "x", "b"), Reference("b", "x", "c")]) == ["c", "b", "a"]
    held = [*LINKS[:1], Reference("chunks", "case_id", "cases", "restrict")]
    with pytest.raises(ValueError, match="chunks hold rows of cases"):
        cascades.deleted(case_tables, KEYS, held, gone)


# --- change logs -------------------------------------------------------------

SOURCE = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("url", StringType()), StructField("refreshed", LongType())])


def test_any_prefix_equals_its_replay(spark):
    rng, events = random.Random(8), []
    for seq in range(1, 121):
        key, what = rng.randrange(8), rng.random()
        if what < 0.15:
            events.append((seq, key, True, [], None, None, None))
        else:
            names = rng.sample(["name", "url", "refreshed"], rng.randint(1, 3))
            events.append((seq, key, False, names, *[rng.choice([None, f"{n}{seq}"]) if n in names else None for n in ("name", "url")], seq if "refreshed" in names else None))

    def by_hand(upto):
        rows = {}
        for seq, key, gone, names, *values in events:
            if seq <= upto:
                if gone:
                    rows.pop(key, None)
                else:
                    row = rows.setdefault(key, {"name": None, "url": None, "refreshed": None})
                    row.update({n: v for n, v in zip(("name", "url", "refreshed"), values) if n in names})
        return sorted((k, *r.values()) for k, r in rows.items())

    log = changes.ChangeLog(shared.temporary(spark, "log"), "id", SOURCE)
    schema = "seq long, id long, gone boolean, names array<string>, name string, url string, refreshed long"
    state = lambda upto=None: sorted(tuple(r) for r in log.state(spark, upto).collect())
    for part in (events[:50], events[50:90], events[90:]):
        log.append(spark.createDataFrame(part, schema))
        assert state() == by_hand(part[-1][0])
        if part[-1][0] < 120:
            assert log.compact(spark) == part[-1][0] == log.compact(spark)
    assert log.versions(spark) == [50, 90]
    for upto in (0, 1, 20, 50, 51, 70, 90, 91, 120):
        assert state(upto) == by_hand(upto)


def test_runs(spark):
    schema = StructType([StructField(n, t) for n, t in (("run_id", LongType()), ("source_id", LongType()), ("started_at", StringType()), ("completed_at", StringType()), ("status", StringType()), ("summary", StringType()))])
    log = changes.ChangeLog(shared.temporary(spark, "runs"), "run_id", schema)
    one = spark.range(1)
    log.append(changes.runs_started(one, F.lit(1), F.lit(7), F.lit(3), F.lit("t0")))
    assert [tuple(r) for r in log.state(spark).collect()] == [(7, 3, "t0", None, "running", "{}")]
    log.append(changes.runs_completed(one, F.lit(2), F.lit(7), F.lit("t1"), F.lit("failed"), F.lit('{"e": 1}')))
    assert [tuple(r) for r in log.state(spark).collect()] == [(7, 3, "t0", "t1", "failed", '{"e": 1}')]


def test_levels_are_carried_by_one_sort(spark):
    rows = spark.createDataFrame([("p", 1, "division", "D1"), ("p", 2, "part", "P1"), ("p", 3, "part", None), ("p", 4, None, "x"), ("p", 5, "title", "T"), ("p", 6, "division", "D2")], "page string, i long, level string, value string")
    found = contents.carried_levels(rows, "page", ["i"])
    got = [(r.i, r.division, r.title, r.part) for r in found.orderBy("i").collect()]
    assert got == [(1, "D1", "", ""), (2, "D1", "", "P1"), (3, "D1", "", "P1"), (4, "D1", "", "P1"), (5, "D1", "T", ""), (6, "D2", "", "")]
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
