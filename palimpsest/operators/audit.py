"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.masking import audit


def _each(rows: DataFrame, array: Column | str, name: str) -> DataFrame:
    """The elements of array, a row each.

    For a plain explode Spark infers a filter on the array's size and pushes it
    through all rounds of a review, its expression doubling in each.
    """
    return rows.select(F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def counts_by_kind(rows: DataFrame, changes: str = "changes") -> DataFrame:
    """(kind, occurrences, values, documents) over all rows; kinds are few, so the shuffle is tiny."""
    flat = _each(rows, changes, "c")
    return flat.groupBy("c.kind").agg(F.sum("c.occurrences").cast("long").alias("occurrences"), F.count("*").alias("documents"))


def rollup(rows: DataFrame, *by: str, changes: str = "changes") -> DataFrame:
    """Documents, masked documents and replacements by every prefix of the columns by."""
    done = F.aggregate(changes, F.lit(0).cast("long"), lambda a, c: a + c["occurrences"])
    return rows.withColumn("__n", done).rollup(*by).agg(F.count("*").alias("documents"), F.count_if(F.col("__n") > 0).alias("masked_documents"), F.sum("__n").alias("occurrences"))


def collisions(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Placeholders that stand for several values: (placeholder, values)."""
    flat = _each(plans, plan, "p").select("p.placeholder", "p.value")
    return flat.groupBy("placeholder").agg(F.countDistinct("value").alias("values")).where("values > 1")


def gauges(jobs: DataFrame, status: str = "status") -> DataFrame:
    """One row: jobs, and how many of them are pending, processing, done and error; zeros for none."""
    return jobs.agg(F.count("*").alias("jobs"), *[F.count_if(F.col(status) == s).alias(s) for s in ("pending", "processing", "done", "error")])


def observed(rows: DataFrame, as_it_goes: Observation | str) -> DataFrame:
    """rows of sanitised(), which tell documents, errors and replacements when an action ends, or a stream's listener at each trigger."""
    total = F.coalesce(F.sum(F.col("total_masked")), F.lit(0)).cast("long")
    return rows.observe(as_it_goes, F.count("*").alias("documents"), F.count_if(F.col("status") == "error").alias("errors"), total.alias("values_masked"))


def counts_in_order(counts: Column) -> Column:
    """A map of kind to count as an array of (kind, n), the largest first; of equal ones the first of the map."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e, i: F.struct((-e["value"]).alias("less"), i.alias("i"), e["key"].alias("kind"))))
    return F.transform(entries, lambda e: F.struct(e["kind"].alias("kind"), (-e["less"]).alias("n")))


def changes_in_order(changes: Column) -> Column:
    """Changes by kind, then placeholder; null sorts as an empty text, and equal ones stay in order."""
    first = lambda c, f: F.coalesce(c[f], F.lit("")).alias(f"by_{f}")
    return F.transform(F.array_sort(F.transform(changes, lambda c, i: F.struct(first(c, "kind"), first(c, "placeholder"), i.alias("i"), c.alias("c")))), lambda x: x["c"])


def report(job: Column, status: Column, filename: Column, kind: Column, method: Column, chars: Column, rounds: Column, seconds: Column, changes: Column, by_kind: Column, warnings: Column) -> Column:
    """A Markdown report of a row that shows no value, only previews."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    bar = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    head = F.array(
        F.lit("# PII removal report"), F.lit(""), F.concat(F.lit("- Job: `"), job.cast("string"), F.lit("`")), F.concat(F.lit("- Status: "), status),
        F.concat(F.lit("- Source file: "), text(filename)), F.concat(F.lit("- Document kind: "), text(kind)), F.concat(F.lit("- Extraction method: "), text(method)),
        F.concat(F.lit("- Characters: "), text(chars)), F.concat(F.lit("- Distinct values masked: "), F.size(changes).cast("string")),
        F.concat(F.lit("- Critic rounds: "), text(rounds)), F.concat(F.lit("- Duration: "), text(seconds), F.lit(" s")), F.lit(""), F.lit("## Masked categories"), F.lit(""),
    )
    ordered = F.array_sort(F.transform(F.map_entries(by_kind), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("kind"))))
    table = F.concat(F.array(F.lit("| category | count |"), F.lit("| --- | --- |")), F.transform(ordered, lambda e: F.concat(F.lit("| "), e["kind"], F.lit(" | "), (-e["n"]).cast("string"), F.lit(" |"))))
    # The wording of the report.
    middle = F.array(*[F.lit(x) for x in ("", "## Redaction table", "", "Placeholders are stable per deployment: the same value always maps to the same", "token, and the original cannot be recovered from it. Originals appear only as a", "masked preview so this report stays safe to share.", "")])
    shown = F.array_sort(F.transform(audit(changes), lambda c: F.struct(bar(c["kind"]).alias("kind"), bar(c["placeholder"]).alias("placeholder"), bar(c["original"]).alias("original"))))
    lines = F.transform(shown, lambda c: F.concat(F.lit("| `"), c["placeholder"], F.lit("` | "), c["kind"], F.lit(" | `"), c["original"], F.lit("` |")))
    redactions = F.concat(F.array(F.lit("| redaction | type | original (masked) |"), F.lit("| --- | --- | --- |")), lines)
    warned = F.concat(F.array(F.lit("## Warnings"), F.lit("")), F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), F.array(F.lit("")))
    note = F.array(*[F.lit(x) for x in ("## Note", "", "This report intentionally contains no original PII. The cleaned document is", "stored encrypted at rest and is never written as plaintext by the application.")])
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(
        head, F.when(F.size(by_kind) > 0, table).otherwise(F.array(F.lit("- none detected"))), middle,
        F.when(F.size(changes) > 0, redactions).otherwise(F.array(F.lit("- none"))), F.when(F.size(warnings) > 0, warned).otherwise(none), note,
    ), "\n", "")
