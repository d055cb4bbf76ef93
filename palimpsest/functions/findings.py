"""The algebra of findings and reviews, within a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import HARD_KINDS
from .text import kind_of

FINDINGS = "array<struct<kind: string, value: string, start: int, end: int, context: string, confidence: double, source: string>>"
MISSING = "array<struct<kind: string, value: string, context: string, confidence: double>>"
CRITIQUE = f"struct<agreement: double, accepted: boolean, missing: {MISSING}, false_positives: array<string>, over_masking: array<string>, feedback: array<string>, wrong_kind: array<struct<value: string, kind: string>>>"


def _finding(f: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, f[k]).alias(k) for k in ("kind", "value", "start", "end", "context", "confidence", "source")])


def _same(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["value"] == b["value"])


def _keys(findings: Column) -> Column:
    return F.array_distinct(F.transform(findings, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"))))


def _last_of_each(findings: Column) -> Column:
    """One finding for each (kind, value), in order of the first but as the last has it."""
    return F.transform(_keys(findings), lambda k: F.element_at(F.filter(findings, lambda f: _same(f, k)), -1))


def from_spans(spans: Column, source: str = "detector") -> Column:
    """Findings of validated spans."""
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("context"), s["confidence"].alias("confidence"), F.lit(source).alias("source")))


def augmented(findings: Column, extra: Column) -> Column:
    """findings and the extra ones with new keys; a person found twice keeps the higher confidence."""

    def surer(f: Column) -> Column:
        again = F.filter(extra, lambda e: _same(e, f))
        most = F.greatest(f["confidence"], F.array_max(F.transform(again, lambda e: e["confidence"])))
        return _finding(f, confidence=F.when(f["kind"] == "PERSON", most).otherwise(f["confidence"]))

    old = F.transform(_last_of_each(findings), surer)
    new = F.filter(extra, lambda e: ~F.exists(findings, lambda f: _same(f, e)))
    first = F.transform(_keys(new), lambda k: surer(F.get(F.filter(new, lambda e: _same(e, k)), F.lit(0))))
    return F.when(F.size(extra) > 0, F.concat(old, first)).otherwise(findings)


def merged(findings: Column, critique: Column, fix_kinds: bool = False) -> Column:
    """findings without those rejected, and what the reviewer misses; what was found before can't come in again as missing.

    fix_kinds also applies the reviewer's corrections of kinds.
    """
    rejected = F.filter(critique["false_positives"], lambda v: v != "")
    kept = F.filter(findings, lambda f: ~F.array_contains(rejected, f["value"]))
    null = F.lit(None).cast("int")
    missed = F.transform(critique["missing"], lambda m: F.struct(kind_of(m["kind"]).alias("kind"), F.btrim(F.coalesce(m["value"], F.lit(""))).alias("value"), null.alias("start"), null.alias("end"), F.left(F.coalesce(m["context"], F.lit("")), F.lit(240)).alias("context"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(m["confidence"], F.lit(0.6)))).alias("confidence"), F.lit("critic").alias("source")))
    missed = F.filter(missed, lambda m: (m["value"] != "") & ~F.exists(findings, lambda f: _same(f, m)))
    out = F.concat(kept, F.transform(_keys(missed), lambda k: F.get(F.filter(missed, lambda m: _same(m, k)), F.lit(0))))
    if fix_kinds:
        right = lambda f: F.element_at(F.filter(critique["wrong_kind"], lambda w: w["value"] == f["value"]), -1)["kind"]
        out = F.transform(out, lambda f: _finding(f, kind=F.when(F.exists(critique["wrong_kind"], lambda w: w["value"] == f["value"]), kind_of(right(f))).otherwise(f["kind"])))
    return out


def reconciled(findings: Column, critique: Column, validated: Column) -> Column:
    """findings without those rejected, and validated spans that are not among them.

    A rejection doesn't keep a validated span of a hard kind out; over_masking does.
    """
    rejected = F.filter(critique["false_positives"], lambda v: v != "")
    kept = _last_of_each(F.filter(findings, lambda f: ~F.array_contains(rejected, f["value"])))
    over = F.filter(critique["over_masking"], lambda v: v != "")
    fresh = F.filter(from_spans(validated, "normaliser"), lambda s: ~F.array_contains(over, s["value"]) & (~F.array_contains(rejected, s["value"]) | s["kind"].isin(*HARD_KINDS)))
    fresh = F.filter(fresh, lambda s: ~F.exists(kept, lambda f: _same(f, s)))
    return F.concat(kept, F.transform(_keys(fresh), lambda k: F.get(F.filter(fresh, lambda s: _same(s, k)), F.lit(0))))


def reviewable(findings: Column, text: Column) -> Column:
    """Those whose value stands in the text."""
    return F.filter(findings, lambda f: (f["value"] != "") & F.contains(text, f["value"]))


def converged(critique: Column, threshold: float = 0.9) -> Column:
    return critique["accepted"] | ((F.size(critique["missing"]) == 0) & (critique["agreement"] >= threshold))


def agreed() -> Column:
    """The review of a reviewer that accepts everything."""
    return F.from_json(F.lit('{"agreement": 1.0, "accepted": true, "missing": [], "false_positives": [], "over_masking": [], "feedback": ["the findings were accepted"], "wrong_kind": []}'), CRITIQUE)


def uncovered_names(findings: Column) -> Column:
    """Persons whose value isn't also found as something else."""
    others = F.transform(F.filter(findings, lambda f: f["kind"] != "PERSON"), lambda f: f["value"])
    return F.filter(findings, lambda f: (f["kind"] == "PERSON") & ~F.array_contains(others, f["value"]))
