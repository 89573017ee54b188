"""Dates, money and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fixed


def deadline_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.DEADLINES), "claim_type string, ordinal int, name string, filing_entity string, days int, months int, years int")


def offset_date(day: Column, days: Column, months: Column, years: Column) -> Column:
    """The day moved by years, else months, else days; ends of months are kept within the month."""
    return F.when(years.isNotNull(), F.add_months(day, years * 12)).when(months.isNotNull(), F.add_months(day, months)).otherwise(F.date_add(day, days))


def urgency(days_left: Column) -> Column:
    return F.when(days_left < 0, "expired").when(days_left < 30, "critical").when(days_left < 90, "urgent").otherwise("normal")


def deadlines(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule of an incident's claim type (claim_type, incident_date, as_of) with its deadline, days left and urgency.

    The rules are a fixed table of a few rows, so they may be broadcast.
    """
    joined = incidents.join(F.broadcast(rules), "claim_type")
    joined = joined.withColumn("deadline", offset_date(F.col("incident_date"), F.col("days"), F.col("months"), F.col("years")))
    joined = joined.withColumn("days_left", F.datediff("deadline", "as_of"))
    return joined.withColumn("urgency", urgency(F.col("days_left"))).drop("days", "months", "years")


def money(amount: Column) -> Column:
    return F.round(amount, 2).cast("decimal(18,2)")


def wage_items(claims: DataFrame, key: str) -> DataFrame:
    """Line items (category, amount) of wage claims, each rounded to cents.

    Columns: hourly_rate and unpaid_hours decimal(12,4), employment_status,
    termination_date, paid_date, meal_breaks, rest_breaks, unpaid_since, as_of.
    """
    rate, hours = F.col("hourly_rate"), F.col("unpaid_hours")
    wages = (rate * hours).cast("decimal(24,8)")
    due = F.when(F.col("employment_status") == "quit_without_notice", F.date_add("termination_date", 3)).otherwise(F.col("termination_date"))
    late = F.greatest(F.datediff(F.coalesce("paid_date", "as_of"), due), F.lit(0))
    waiting = (rate * 8 * F.least(late, F.lit(30))).cast("decimal(24,8)")
    days = F.datediff("as_of", "unpaid_since")
    interest = (wages * F.lit("0.10").cast("decimal(3,2)") * days / 365).cast("decimal(38,10)")
    item = lambda name, amount, when: F.when(when, F.struct(F.lit(name).alias("category"), money(amount).alias("amount")))
    items = F.array(
        item("unpaid_wages", wages, F.lit(True)),
        item("meal_break_premium", rate * F.col("meal_breaks"), F.col("meal_breaks") > 0),
        item("rest_break_premium", rate * F.col("rest_breaks"), F.col("rest_breaks") > 0),
        item("waiting_time_penalty", waiting, (F.col("employment_status") != "still_employed") & F.col("termination_date").isNotNull()),
        item("interest", interest, F.col("unpaid_since").isNotNull() & (wages > 0) & (days > 0)),
    )
    return claims.select(key, F.explode(F.array_compact(items)).alias("item")).select(key, "item.category", "item.amount")


def discovery_dates(cases: DataFrame) -> DataFrame:
    """Cutoffs before trial_date, and the response due after service_date by service_method, with days left at as_of."""
    # Days added by the method of service.
    extra = {"personal": 0, "mail_in_state": 5, "mail_out_of_state": 10, "mail_international": 20, "electronic": 2, "overnight": 2}
    added = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in extra.items() for x in kv]), F.col("service_method")), F.lit(0))
    out = cases.withColumn("discovery_cutoff", F.date_sub("trial_date", 30)).withColumn("motion_cutoff", F.date_sub("trial_date", 15))
    return out.withColumn("response_due", F.date_add("service_date", added + 30)).withColumn("days_to_cutoff", F.datediff("discovery_cutoff", "as_of"))


def intake_scores(answers: DataFrame, signals: DataFrame, issues: DataFrame, by: str, threshold: float = 0.8, high: float = 1.5) -> DataFrame:
    """Issues (issue_type, ordinal) by the weights of given answers (answer_key), above a threshold, with their confidence and rank."""
    from docloom.operators.retrieval import ranked

    scored = answers.join(signals, "answer_key").groupBy(by, "issue_type").agg(F.round(F.sum("weight"), 6).alias("score"))
    kept = scored.where(F.col("score") >= threshold).join(issues, "issue_type").withColumn("confidence", F.when(F.col("score") >= high, "high").otherwise("medium"))
    return ranked(kept, F.desc("score"), "ordinal", by=by)


def routing(issues: DataFrame, rules: DataFrame, agencies: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """Agencies for each issue, prerequisites of government employees first of their priority, by priority and then rule order."""
    from docloom.operators.retrieval import ranked

    usual = issues.join(rules, "issue_type").select("case_id", "agency_key", "priority", "ordinal")
    before = issues.where("is_government").join(prerequisites, "issue_type").select("case_id", "agency_key", "priority", F.lit(-1).alias("ordinal"))
    order = F.when(F.col("priority") == "prerequisite", 0).when(F.col("priority") == "primary", 1).when(F.col("priority") == "alternative", 2).otherwise(3)
    return ranked(usual.unionByName(before).join(agencies, "agency_key"), order, "ordinal", "agency_key", by="case_id")


def suggestions(rows: DataFrame, by: str, base: str, override: str) -> DataFrame:
    """Sorted unions of array columns; the override's is null only if all its arrays are."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy(by).agg(union(base).alias(base), F.when(F.count(override) > 0, union(override)).alias(override))


def selected(requests: DataFrame, by: str, limit: int = 35) -> DataFrame:
    """Per group the number of selected requests and whether it exceeds the limit."""
    n = F.count_if("is_selected")
    return requests.groupBy(by).agg(n.alias("n_selected"), (n > limit).alias("exceeds_limit"))


def item_totals(items: DataFrame, key: str) -> DataFrame:
    """key, total, n: the sum of amounts that were rounded one by one, so that the total is that of the lines shown."""
    return items.groupBy(key).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))


def definitions(cases: DataFrame, bank: DataFrame, employee: str = "employee", employer: str = "employer") -> DataFrame:
    """cases with ordinal, term, definition: each term of the bank (ordinal, term, template), the parties' names in place of {EMPLOYEE} and {EMPLOYER}.

    The bank travels as one array in each row's plan (a few terms, collected), so
    every case meets every term without a join. A party without a name stands as
    [EMPLOYEE NAME] or [EMPLOYER NAME].
    """
    terms = [F.struct(F.lit(r["ordinal"]).alias("ordinal"), F.lit(r["term"]).alias("term"), F.lit(r["template"]).alias("template")) for r in bank.orderBy("ordinal").collect()]
    each = cases.withColumn("_t", F.explode(F.array(*terms)))
    name = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    told = F.replace(F.replace(F.col("_t.template"), F.lit("{EMPLOYEE}"), name(employee, "[EMPLOYEE NAME]")), F.lit("{EMPLOYER}"), name(employer, "[EMPLOYER NAME]"))
    return each.select(*cases.columns, "_t.ordinal", "_t.term", told.alias("definition"))


def incident_guides(incidents: DataFrame, guides: DataFrame, fields: DataFrame, by: str = "type") -> DataFrame:
    """Incidents with their type's guide: the guide's columns and its fields (type, ordinal, others) as an array in order; null without a guide."""
    others = [c for c in fields.columns if c != by]
    gathered = fields.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("_fields"))
    whole = guides.join(gathered, by, "left").withColumn("fields", F.coalesce("_fields", F.array().cast(gathered.schema["_fields"].dataType))).drop("_fields")
    return incidents.join(whole, by, "left")
