"""Checks across all sources, answer evaluation, and the reports that tell of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of a statute's citation: a code's name, a section sign, a number. Own pattern.
CITATION_FORM = r"^.+ § \d+[A-Za-z0-9.()-]*$"


def source_figures(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source (source_id, slug, source_type): documents, chunks, active ones, citations, categories, and tokens of the active ones.

    documents and chunks (is_active, token_count, citation, content_category,
    content) have source_id; sources without any have zeros. Each table is
    aggregated before it is joined.
    """
    docs = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    active = F.col("is_active")
    per = chunks.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(active).alias("active"), F.avg(F.when(active, F.col("token_count"))).alias("avg_tokens"), F.min(F.when(active, F.col("token_count"))).alias("min_tokens"),
        F.max(F.when(active, F.col("token_count"))).alias("max_tokens"), F.count_if(F.coalesce("citation", F.lit("")) != "").alias("citations"),
        F.count_if(F.col("content_category") == "statutory_code").alias("statutory"), F.count_if((F.coalesce("citation", F.lit("")) != "") & F.col("citation").rlike(CITATION_FORM)).alias("well_formed"),
        F.count_if(F.trim(F.regexp_replace("content", r"\s+", " ")) == "").alias("empty"),
    )
    return sources.join(docs, "source_id", "left").join(per, "source_id", "left").fillna(0)


def checks(figures: DataFrame, duplicates: DataFrame) -> DataFrame:
    """name, passed, message of seven families of checks; `duplicates` are the hashes that several sources have.

    Of each source: it has documents; statutory ones have citations and no other
    category; tokens are within 1 to 10,000 (where there are chunks). Of all: every
    citation of statutory sources has the form of one, duplicates (told, never
    failed), no chunk is blank.
    """
    text = lambda c: F.col(c).cast("string")
    row = lambda name, passed, *message: F.struct(F.concat("slug", F.lit(f"_{name}")).alias("name"), passed.alias("passed"), F.concat(*message).alias("message"))
    statutory = F.col("source_type") == "statutory_code"
    own = F.array(
        row("has_content", F.col("documents") > 0, text("documents"), F.lit(" documents, "), text("chunks"), F.lit(" chunks")),
        F.when(statutory, row("has_citations", F.col("citations") > 0, text("citations"), F.lit("/"), text("chunks"), F.lit(" chunks have citations"))),
        F.when(statutory, row("correct_category", F.col("statutory") == F.col("chunks"), text("statutory"), F.lit("/"), text("chunks"), F.lit(" chunks are statutory_code"))),
        F.when(F.col("chunks") > 0, row("token_bounds", (F.col("min_tokens") >= 1) & (F.col("max_tokens") <= 10_000), F.lit("Token range: "), text("min_tokens"), F.lit("-"), text("max_tokens"))),
    )
    each = figures.select(F.explode(F.array_compact(own)).alias("c")).select("c.*")
    total = figures.agg(F.sum(F.when(statutory, F.col("citations")).otherwise(0)).alias("cited"), F.sum(F.when(statutory, F.col("well_formed")).otherwise(0)).alias("good"), F.sum("empty").alias("empty"))
    whole = F.array(
        F.when(F.col("cited") > 0, F.struct(F.lit("citation_format_validation").alias("name"), (F.col("good") == F.col("cited")).alias("passed"), F.concat(text("good"), F.lit("/"), text("cited"), F.lit(" citations match the expected format")).alias("message"))),
        F.struct(F.lit("no_empty_chunks").alias("name"), (F.col("empty") == 0).alias("passed"), F.when(F.col("empty") == 0, "No empty chunks").otherwise(F.concat(text("empty"), F.lit(" empty chunks found"))).alias("message")),
    )
    twice = duplicates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("cross_source_duplicates").alias("name"), F.lit(True).alias("passed"), F.concat(text("n"), F.lit(" content hashes appear in multiple sources")).alias("message"))
    return each.unionByName(total.select(F.explode(F.array_compact(whole)).alias("c")).select("c.*")).unionByName(twice)


def report_lines(figures: DataFrame, found: DataFrame) -> DataFrame:
    """part, place, line of the report in Markdown: status, a table of the sources, a list of the checks, in order of part and place."""
    text = lambda c: F.col(c).cast("string")
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"))
    head = counts.select(F.posexplode(F.array(F.lit("# Validation report"), F.concat(F.lit("**Status:** "), F.when(F.col("n") == F.col("ok"), "PASS").otherwise("FAIL")), F.concat(F.lit("**Checks:** "), text("ok"), F.lit("/"), text("n"), F.lit(" passed")))).alias("i", "line"))
    cells = ["slug", "source_type", "documents", "chunks", "active", "citations"]
    table = figures.select(F.col("slug").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(text, cells)), F.lit(" |")).alias("line"))
    listed = found.select(F.col("name").alias("place"), F.concat(F.lit("- **["), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("]** `"), "name", F.lit("`: "), "message").alias("line"))
    parts = [head.select(F.lit(0).alias("part"), text("i").alias("place"), "line"), table.select(F.lit(1).alias("part"), "place", "line"), listed.select(F.lit(2).alias("part"), "place", "line")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_json(figures: DataFrame) -> DataFrame:
    """One JSON text a source, with its figures."""
    return figures.select("slug", F.to_json(F.struct(*figures.columns)).alias("json"))


def answer_evaluation(answers: DataFrame, by: str = "mode") -> DataFrame:
    """Per mode: rates and averages, each over the answers that the figure applies to.

    answers has n_results, and disclaimer (boolean), level, length, cost, accuracy,
    completeness (null where it was not taken). A rate without any answer is null;
    the reading level is that of answers with text.
    """
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return answers.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_results"), 6).alias("avg_results"), rate("disclaimer").alias("disclaimer_rate"), F.round(F.avg(F.when(F.col("length") > 0, F.col("level"))), 6).alias("avg_level"),
        F.round(F.avg("accuracy"), 6).alias("avg_accuracy"), F.round(F.avg("completeness"), 6).alias("avg_completeness"), F.round(F.sum("cost"), 6).alias("total_cost"), F.count_if(F.col("n_results") == 0).alias("without_results"),
    )


def feedback_summary(feedback: DataFrame, log: DataFrame, since: Column, key: str = "query_id", at: str = "created_at") -> DataFrame:
    """One row: thumbs up and down, feedback and questions since then, and both rates; feedback counts by its question's time."""
    recent = log.where(F.col(at) >= since)
    votes = feedback.join(recent.select(key), key).agg(F.count(F.lit(1)).alias("total_feedback"), F.count_if(F.col("rating") == 1).alias("thumbs_up"), F.count_if(F.col("rating") == -1).alias("thumbs_down"))
    asked = recent.agg(F.count(F.lit(1)).alias("total_queries"))
    both = votes.withColumn("_k", F.lit(1)).join(asked.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    rate = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 3), F.lit(0.0))
    return both.withColumns({"approval_rate": rate("thumbs_up", "total_feedback"), "feedback_rate": rate("total_feedback", "total_queries")})
