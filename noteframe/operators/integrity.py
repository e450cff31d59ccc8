"""Integrity of the tables as one long report: what a database would refuse, counted for all rows at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIQUE = (("users", "email"), ("users", "username"), ("users", "google_id"), ("notes", "share_token"))
REQUIRED = (("users", "email"), ("users", "username"), ("notebooks", "name"), ("flashcards", "question"), ("flashcards", "answer"), ("ai_explanations", "note_id"))
LENGTHS = (("users", "email", 255), ("users", "username", 100), ("notes", "title", 255), ("notes", "subject", 100), ("notes", "topic", 100), ("notes", "tags", 500), ("notes", "share_token", 36), ("notebooks", "name", 255), ("notebooks", "color", 7))
PARENTS = (
    ("notes", "owner_id", "users"), ("notebooks", "owner_id", "users"), ("note_notebooks", "note_id", "notes"), ("note_notebooks", "notebook_id", "notebooks"),
    ("flashcard_sets", "note_id", "notes"), ("flashcards", "set_id", "flashcard_sets"), ("ai_explanations", "note_id", "notes"),
)
STATUSES = ("pending", "processing", "completed", "needs_review", "failed")
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """rule, table, column and violations (rows; for uniqueness: values that repeat) of every rule whose table is given."""
    parts = []

    def add(rule: str, table: str, column: str, found: DataFrame) -> None:
        parts.append(found.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), F.lit(column).alias("column"), "violations"))

    def given(rules: tuple) -> list:
        return [r for r in rules if r[0] in tables and r[1] in tables[r[0]].columns]

    for name, c in given(UNIQUE):
        add("unique", name, c, tables[name].where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1"))
    for name, c in given(REQUIRED):
        add("not_null", name, c, tables[name].where(F.col(c).isNull()))
    for name, c, most in given(LENGTHS):
        add("length", name, c, tables[name].where(F.length(c) > most))
    for name, c, parent in given(PARENTS):
        if parent in tables:
            keys = tables[parent].select(F.col("id").alias(c))
            add("orphan", name, c, tables[name].where(F.col(c).isNotNull()).join(keys, c, "left_anti"))
    if "notes" in tables:
        add("enum", "notes", "status", tables["notes"].where(~F.col("status").isin(*STATUSES)))
    if "users" in tables:
        add("email", "users", "email", tables["users"].where(~F.col("email").rlike(EMAIL)))
    return reduce(DataFrame.unionByName, parts)
