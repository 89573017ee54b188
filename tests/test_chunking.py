"""Chunks of Spark against the plain chunkers, on texts of all shapes."""

import random

import plain_chunks
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.sources import files


def texts(seed, marks=(" ", " ", ". ", "? ", "\n", "\n\n", "\n\n\n")):
    rng = random.Random(seed)
    out = ["", " \n ", "x", "y" * 1000, "a. b. c.", "\n\nlead\n\n", "w " * 300]
    for _ in range(60):
        out.append("".join(rng.choice("abcdef") * rng.choice([1, 3, 8, 40, 90]) + rng.choice(marks) for _ in range(rng.randint(1, 60))))
    return out


def held_against(spark, cut, plain, rows):
    """Rows (text, name) through both; what Spark gives is in order and numbered."""
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "k long, body string, name string").withColumn("content", F.lit("clash"))
    got = {}
    for r in cut(df.drop("content"), "body", "name", "k").collect():
        got.setdefault(r.k, []).append((r.chunk_index, r.content, r.heading_path, r.token_count))
    for i, (text, name) in enumerate(rows):
        want = [c if isinstance(c, tuple) else (c, name) for c in plain(text, name)]
        assert sorted(got.get(i, [])) == [(j, c, p, plain_chunks.size_of(c)) for j, (c, p) in enumerate(want)], (i, text)


@pytest.mark.parametrize("limit, overlap", [(20, 0), (25, 8), (60, 30)])
def test_plain_and_opinions(spark, limit, overlap):
    rows = [(t, f"n{i}") for i, t in enumerate(texts(1))]
    held_against(spark, lambda *a: chunking.opinion_chunks(*a, limit=limit, overlap=overlap), lambda t, n: plain_chunks.opinion_chunks(t, n, limit, overlap), rows)
    held_against(spark, lambda *a: chunking.plain_chunks(*a, limit=limit, overlap=overlap), lambda t, n: plain_chunks.file_chunks(t, n, "txt", limit, overlap), rows)


@pytest.mark.parametrize("limit, overlap", [(20, 5), (60, 10)])
def test_statutes(spark, limit, overlap):
    rows = [(t, f"Lab. Code § {i}") for i, t in enumerate(texts(2, (" ", ". ", "\n", "\n(a) ", "\n(b)\n", "\n\n")) + ["(a) one\n(b) " + "two " * 40, "(a) x" * 60])]
    held_against(spark, lambda *a: chunking.statute_chunks(*a, limit=limit, overlap=overlap), lambda t, n: plain_chunks.statute_chunks(t, n, limit, overlap), rows)


@pytest.mark.parametrize("least, limit, overlap", [(5, 20, 5), (15, 40, 10), (30, 60, 0)])
def test_documents(spark, least, limit, overlap):
    rows = [(t, random.Random(i).choice(["", "Title", "A"])) for i, t in enumerate(texts(3, (" ", ". ", "\n", "\n# A\n", "\n### b c \n", "\n## \n", "\n#no\n", "\n\n", "\n####### seven\n")) + ["# A\n## B\n# C\ntext", "### deep\nx\n# top\ny"])]
    held_against(spark, lambda *a: chunking.document_chunks(*a, least=least, limit=limit, overlap=overlap), lambda t, n: plain_chunks.document_chunks(t, n, least, limit, overlap), rows)


@pytest.mark.parametrize("kind", ["pdf", "csv", "eml", "txt"])
def test_files(spark, kind):
    marks = (" ", ". ", "\n", "\f", "\f \f", "\n---\n", "\n---\n \n---\n", "\n## S\n", "\n## \n", "\n\n")
    rows = [(t, f"f{i}.{kind}") for i, t in enumerate(texts(4, marks) + ["## S\na", "\n---\n", "one\f\ftwo\f" + "x" * 500])]
    cut = lambda df, text, name, key: chunking.file_chunks(df.withColumn("kind", F.lit(kind)), text, name, "kind", key, limit=30, overlap=8)
    held_against(spark, cut, lambda t, n: plain_chunks.file_chunks(t, n, kind, 30, 8), rows)


def test_no_text_leaves_for_python(spark):
    """The folds get numbers: no Python step of the plan has a column of strings."""
    rows = spark.createDataFrame([(1, "a", "b")], "k long, body string, name string")
    plan = chunking.document_chunks(rows, "body", "name", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    assert chunking.runs_of([5, 5, 5], 10, 5, 0, chunking.STRICT) == [(0, 1, 0), (1, 2, 0)]


def test_workers_of_the_folds_load_little(spark):
    """Each Python step has a worker in every task; only that of the headings above is an Arrow one, the modules of the folds load neither pandas nor Arrow."""
    import subprocess
    import sys

    rows = spark.createDataFrame([(1, "# a\n\nb", "n")], "k long, html string, name string")
    plan = chunking.document_chunks(files.pages_as_markdown(rows), "markdown", "name", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and plan.count("BatchEvalPython") >= 4
    code = "import sys, docloom.functions.folds; assert not {'pandas', 'pyarrow'} & set(sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
