"""Deletion and archiving along declared references between tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.shared import written


class Reference(NamedTuple):
    """`child`.`column` names a row of `parent` by its key; what happens to the child when that row goes: cascade, set null or restrict."""

    child: str
    column: str
    parent: str
    on_delete: str = "cascade"


def in_order(tables: list[str], references: list[Reference]) -> list[str]:
    """Parents before children; a cycle is an error. A table that refers to itself is a cycle too."""
    left, out = {t: {r.parent for r in references if r.child == t} for t in tables}, []
    while left:
        free = sorted(t for t, parents in left.items() if not parents & left.keys())
        if not free:
            raise ValueError(f"references go round in {', '.join(sorted(left))}")
        out += free
        left = {t: p for t, p in left.items() if t not in free}
    return out


def gone_keys(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The keys (column `key`) of each table that go when those of `gone` (table: key) do, tables in order of their references.

    A child's keys are found by a semi join with its parent's, which are written
    before; a table with several parents loses what any of them takes. Rows that do
    not exist take nothing with them. A row that a reference restricts is an error.
    """
    out: dict[str, DataFrame] = {}
    for name in in_order(list(tables), references):
        own = tables[name].select(F.col(keys[name]).alias("key"), *[F.col(r.column).alias(f"_{r.column}") for r in references if r.child == name])
        parts = [own.join(gone[name].select("key"), "key", "left_semi").select("key")] if name in gone else []
        for r in references:
            if r.child == name and r.parent in out and r.on_delete != "set null":
                hit = own.join(out[r.parent].select(F.col("key").alias(f"_{r.column}")), f"_{r.column}", "left_semi")
                if r.on_delete == "restrict" and not hit.isEmpty():
                    raise ValueError(f"rows of {name} hold rows of {r.parent}")
                parts.append(hit.select("key"))
        if parts:
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            out[name] = written(every.distinct(), f"gone-{name}")
    return out


def deleted(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the rows of `gone` and what depends on them; references that are set null lose their value."""
    lost = gone_keys(tables, keys, references, gone)
    out = {}
    for name, rows in tables.items():
        kept = rows.join(lost[name].withColumnRenamed("key", keys[name]), keys[name], "left_anti").select(*rows.columns) if name in lost else rows
        for r in references:
            if r.child == name and r.on_delete == "set null" and r.parent in lost:
                there = lost[r.parent].select(F.col("key").alias("_gone"), F.lit(True).alias("_hit"))
                kept = kept.join(there, kept[r.column] == there["_gone"], "left").withColumn(r.column, F.when(F.col("_hit").isNull(), F.col(r.column))).select(*rows.columns)
        out[name] = kept
    return out


def archived(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], gone: dict[str, DataFrame], at: Column, status: str = "status", changed: str = "updated_at") -> dict[str, DataFrame]:
    """All tables, with those rows marked archived that a deletion would take; rows that were archived before keep their time."""
    lost = gone_keys(tables, keys, references, gone)
    out = {}
    for name, rows in tables.items():
        if name not in lost or status not in rows.columns:
            out[name] = rows
            continue
        there = lost[name].select(F.col("key").alias("_gone"), F.lit(True).alias("_hit"))
        hit = F.col("_hit").isNotNull() & (F.coalesce(status, F.lit("")) != "archived")
        joined = rows.join(there, rows[keys[name]] == there["_gone"], "left")
        when = {changed: F.when(hit, at).otherwise(F.col(changed))} if changed in rows.columns else {}
        out[name] = joined.withColumns({**when, status: F.when(hit, "archived").otherwise(F.col(status))}).select(*rows.columns)
    return out
