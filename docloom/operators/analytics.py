"""Usage, quality and validation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded; 0 where whole is 0."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def daily_stats(log: DataFrame, at: str, mode: str, modes: list[str], cost: str) -> DataFrame:
    """Per day: rows, rows of each mode, mean cost to 6 digits."""
    counts = [F.count_if(F.col(mode) == m).alias(f"n_{m}") for m in modes]
    return log.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), *counts, F.round(F.avg(cost), 6).alias("avg_cost"))


def mean_of_daily(stats: DataFrame, value: str = "avg_cost") -> DataFrame:
    """The unweighted mean of the daily means."""
    return stats.agg(F.round(F.avg(value), 6).alias("mean_of_daily"))


def within_days(at: Column, as_of: Column, days: int) -> Column:
    """Whether a time is on or after midnight `days` before."""
    return at >= F.date_sub(F.to_date(as_of), days).cast("timestamp")


def repeated(rows: DataFrame, keys: list[str], most: int = 20, more_than: int = 1) -> DataFrame:
    """The keys that occur most, more than once; ties by key."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return found.orderBy(F.desc("n"), *keys).limit(most)


def consecutive_failures(runs: DataFrame, key: str, status: str, at: str, good: str, bad: str) -> DataFrame:
    """Per key, the failures after its last success; a null time never counts."""
    last = F.max(F.when(F.col(status) == good, F.col(at))).over(Window.partitionBy(key))
    marked = runs.withColumn("_last", F.coalesce(last, F.lit("1970-01-01").cast("timestamp")))
    return marked.groupBy(key).agg(F.count_if((F.col(status) == bad) & (F.col(at) > F.col("_last"))).alias("failures"))


def cross_source_duplicates(chunks: DataFrame) -> DataFrame:
    """Contents that chunks of more than one source have: hash, number of sources, chunks (source, id) in order."""
    found = chunks.groupBy("content_hash").agg(F.countDistinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))
    return found.where("n_sources > 1")


def source_figures(chunks: DataFrame) -> DataFrame:
    """Per source: documents, chunks, active chunks, and avg, min, max tokens of active ones."""
    active = lambda c: F.when(F.col("is_active"), F.col(c))
    return chunks.groupBy("source_id").agg(
        F.countDistinct("document_id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_active").alias("n_active"),
        F.round(F.avg(active("token_count")), 3).alias("avg_tokens"), F.min(active("token_count")).alias("min_tokens"), F.max(active("token_count")).alias("max_tokens"),
    )


def category_histogram(rows: DataFrame, key: str, category: str) -> DataFrame:
    """Per key a map of category to count."""
    counts = rows.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category), F.col("n"))))).alias("histogram"))


def freshness(age_days: Column, most: float = 7) -> Column:
    return F.when(age_days.isNull(), "NEVER_RUN").when(age_days <= most, "FRESH").otherwise("STALE")


def age_in_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def ranking_metrics(ranked: DataFrame, k: int = 5, by: str = "query_id") -> DataFrame:
    """Per query of ranked rows (rank from 1, relevant): precision among those returned within k, 1 / first relevant rank, hit."""
    top = F.col("rank") <= k
    return ranked.groupBy(by).agg(
        F.round(F.try_divide(F.count_if(top & F.col("relevant")), F.count_if(top)), 6).alias("precision_at_k"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.coalesce(F.bool_or(top & F.col("relevant")), F.lit(False)).alias("hit"),
    )


def recall(found: Column, expected: Column) -> Column:
    """The share of expected strings that some found string contains; 1 if none is expected."""
    hit = F.filter(expected, lambda e: F.exists(found, lambda f: f.contains(e)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(hit) / F.size(expected))


def nearest_rank(rows: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """Per group the value at place floor(n * q) of the ascending order, places from 0."""
    w = Window.partitionBy(by)
    marked = rows.withColumn("_n", F.row_number().over(w.orderBy(value))).withColumn("_all", F.count(F.lit(1)).over(w))
    return marked.where(F.col("_n") == F.floor(F.col("_all") * q) + 1).select(by, F.col(value).alias("value"))


def majority(hits: dict[str, Column]) -> Column:
    """The name with the most hits; the first of equal ones."""
    best = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    out = F.lit(None).cast("string")
    for name, n in reversed(hits.items()):
        out = F.when(n == best, name).otherwise(out)
    return out


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """Price of a call by model, per million tokens in and out."""
    price = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[i])]), model), F.lit(default[i]))
    return (tokens_in * price(0) + tokens_out * price(1)) / F.lit(1_000_000.0)


def coverage(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Per source: active chunks, those embedded, and their percentage to 1 digit."""
    joined = chunks.where("is_active").join(embedded.select("chunk_id", F.lit(True).alias("_done")), "chunk_id", "left")
    return joined.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_active"), F.count("_done").alias("n_embedded"), F.round(100 * F.count("_done") / F.count(F.lit(1)), 1).alias("percent"))


def alternating(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Per conversation: the number of turns, whether turns count from 0 without gaps, and whether roles alternate from the user on."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    expected = F.when(F.col("_n") % 2 == 0, "user").otherwise("assistant")
    return turns.withColumn("_n", n).groupBy(by).agg(F.count(F.lit(1)).alias("n_turns"), F.bool_and(F.col("_n") == F.col(order)).alias("gapless"), F.bool_and(F.col(role) == expected).alias("alternates"))


def compare_runs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of two runs by outcome: same, changed, only in the first, only in the second (key, content_hash)."""
    a, b = first.select(key, F.col("content_hash").alias("_a")), second.select(key, F.col("content_hash").alias("_b"))
    outcome = F.when(F.col("_a").isNull(), "second only").when(F.col("_b").isNull(), "first only").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def audit_stats(audit: DataFrame, status: str, *by: str) -> DataFrame:
    """Rows and each confidence's share of an audit log, by any columns or over all."""
    n = F.count(F.lit(1))
    kinds = ("verified", "unverified", "suspicious")
    return audit.groupBy(*by).agg(n.alias("n"), *[F.count_if(F.col(status) == k).alias(f"n_{k}") for k in kinds], share(F.count_if(F.col(status) == "verified"), n).alias("verified_share"))


def session_stats(sessions: DataFrame, modes: list[str]) -> DataFrame:
    """Sessions (turn_count, mode): number, mean turns to 1 digit, those of several turns, and of each mode."""
    counts = [F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in modes]
    return sessions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("turn_count"), 1), F.lit(0.0)).alias("avg_turns"), F.count_if(F.col("turn_count") > 1).alias("n_several"), *counts)


def dashboard(sources: DataFrame, documents: DataFrame, runs: DataFrame, now: Column, most_days: float = 7) -> DataFrame:
    """Per source (source_id, tier): documents, last run's status, runs failed since the last success, age and freshness.

    Documents (source_id) and runs (source_id, run_id, status, at) are counted
    before they are joined, in one pass each; sources without any have zeros.
    """
    counts = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_documents"))
    failures = consecutive_failures(runs, "source_id", "status", "at", "completed", "failed")
    last = runs.groupBy("source_id").agg(F.max_by("status", "run_id").alias("last_status"), F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("_done"))
    joined = sources.join(counts, "source_id", "left").join(last, "source_id", "left").join(failures, "source_id", "left")
    joined = joined.fillna(0, ["n_documents", "failures"]).withColumn("age_days", age_in_days(F.col("_done"), now))
    return joined.withColumn("status", freshness(F.col("age_days"), most_days)).drop("_done")


def tier_totals(board: DataFrame, tiers: list[str]) -> DataFrame:
    """Per tier of a dashboard, in the given order: sources, documents, and how many are fresh, stale, never run."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    states = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("FRESH", "STALE", "NEVER_RUN")]
    return board.groupBy("tier", place.alias("place")).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n_documents").alias("n_documents"), *states)


def oldest(board: DataFrame) -> DataFrame:
    """One row: the stale sources, and the source of the greatest age; one that never ran is older than any."""
    age = F.coalesce("age_days", F.lit(float("inf")))
    return board.agg(F.count_if(F.col("status") != "FRESH").alias("n_stale"), F.max_by("source_id", F.struct(age, F.col("source_id"))).alias("oldest"))


def answer_checks(answer: Column, elements: Column, sections: list[str], phrases: list[str], topics: Column) -> dict[str, Column]:
    """has_answer, n_found and n_missing of expected elements, has_format (bold headings), has_phrase, on_topic."""
    low = F.lower(answer)
    found = F.size(F.filter(elements, lambda e: low.contains(F.lower(e))))
    heading = [F.lower(answer).contains("**" + s.lower()) for s in sections]
    hits = F.size(F.filter(topics, lambda t: low.contains(F.lower(t))))
    both = lambda cs, start, op: start if not cs else op(cs)
    return {
        "has_answer": F.length(F.trim(answer)) > 50, "n_found": found, "n_missing": F.size(elements) - found,
        "has_format": both(heading, F.lit(True), lambda cs: F.array_min(F.array(*cs))), "has_phrase": both(phrases, F.lit(False), lambda ps: F.array_max(F.array(*[low.contains(p) for p in ps]))),
        "on_topic": hits >= F.floor(F.size(topics) / 2),
    }


def evaluation(metrics: DataFrame, mode: str, thresholds: dict[str, float]) -> DataFrame:
    """Macro-averages by mode of per-query metrics (precision_at_k, reciprocal_rank, hit), and whether precision passes the mode's threshold."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col(mode)), F.lit(0.0))
    found = metrics.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("precision_at_k"), 6).alias("precision"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))
    return found.withColumn("passes", F.col("precision") >= limit)


def checks(figures: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, check, passed: each rule (a condition on the figures) as a row; a null condition fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()])
    return figures.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def bars(rows: DataFrame, value: str, width: int = 30) -> DataFrame:
    """Rows with the length of a bar in proportion to the greatest value, which is found first (one number)."""
    most = rows.agg(F.max(value)).first()[0] or 0
    return rows.withColumn("bar", (F.floor(F.col(value) / most * width) if most > 0 else F.lit(0)).cast("int"))
