"""Mask plans and their application, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pseudonyms import pseudonym
from .scan import nothing
from .text import preview

PLAN = "array<struct<kind: string, value: string, placeholder: string>>"
CHANGES = "array<struct<kind: string, value: string, placeholder: string, occurrences: int>>"


def plan_of(findings: Column, salt: str | bytes, length: int = 6, style: str = "label") -> Column:
    """The distinct (kind, value) of findings with their placeholders, the surest first, then by kind and value."""
    ordered = F.array_sort(F.transform(findings, lambda f: F.struct((-f["confidence"]).alias("unsure"), f["kind"].alias("kind"), f["value"].alias("value"))))
    distinct = F.array_distinct(F.transform(ordered, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"))))
    return F.transform(distinct, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), pseudonym(f["value"], f["kind"], salt, length, style).alias("placeholder")))


def masked(text: Column, plan: Column) -> Column:
    """(text, changes): the plan's values replaced one after another, the longest first.

    Each is looked for in what those before have left, so a value can also be found
    inside a placeholder; values that are not found leave no change.
    """
    order = F.array_sort(F.transform(plan, lambda p, i: F.struct((-F.length(p["value"])).alias("shorter"), i.alias("i"), p["kind"].alias("kind"), p["value"].alias("value"), p["placeholder"].alias("placeholder"))))

    def step(acc: Column, p: Column) -> Column:
        there = (F.length(p["value"]) > 0) & F.contains(acc["text"], p["value"])
        count = ((F.length(acc["text"]) - F.length(F.replace(acc["text"], p["value"], F.lit("")))) / F.length(p["value"])).cast("int")
        one = F.struct(p["kind"].alias("kind"), p["value"].alias("value"), p["placeholder"].alias("placeholder"), count.alias("occurrences"))
        return F.when(there, F.struct(F.replace(acc["text"], p["value"], p["placeholder"]).alias("text"), F.concat(acc["changes"], F.array(one)).alias("changes"))).otherwise(acc)

    return F.aggregate(order, F.struct(F.coalesce(text, F.lit("")).alias("text"), nothing(CHANGES).alias("changes")), step)


def by_kind(changes: Column) -> Column:
    """map of kind to the occurrences replaced."""
    kinds = F.array_distinct(F.transform(changes, lambda c: c["kind"]))
    total = lambda k: F.aggregate(F.filter(changes, lambda c: c["kind"] == k), F.lit(0).cast("long"), lambda a, c: a + c["occurrences"])
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, total(k))))


def leaks(text: Column, plan: Column) -> Column:
    """The plan's values that still stand in text."""
    return F.transform(F.filter(plan, lambda p: (F.length(p["value"]) > 0) & F.contains(text, p["value"])), lambda p: p["value"])


def accepted(model_text: Column, text: Column, plan: Column) -> Column:
    """A model's masked text if it isn't blank and leaks nothing, else our own."""
    return F.when(model_text.rlike(r"[^\s\x1c-\x1f]") & (F.size(leaks(model_text, plan)) == 0), model_text).otherwise(text)


def audit(changes: Column) -> Column:
    """Changes fit to be shown: values as previews only."""
    return F.transform(changes, lambda c: F.struct(c["kind"].alias("kind"), preview(c["value"]).alias("original"), c["placeholder"].alias("placeholder"), c["occurrences"].alias("occurrences")))
