"""Person names without a model: from labels, e-mail addresses and lone capitalised lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import strip
from .findings import FINDINGS
from .patterns import WS
from .scan import nothing

# The shapes of the three rules.
LABEL = r"(?imud)^[ \t]*(?:full[ \t]+name|name|candidate|holder|account[ \t]+holder|employee|patient|advisor|contact[ \t]+person)[ \t]*:[ \t]*([A-Z][^\n|]{2,60})"
EMAIL_LOCAL = r"(?<![\p{L}\p{N}_.])[A-Za-z]{2,}(?:[._-][A-Za-z]{2,})+(?=@)"
LINE = r"(?md)^[ \t]*([A-Z][a-zà-öø-ÿ]{1,20}(?:[ \t]+[A-Z][a-zà-öø-ÿ]{1,20}){1,3})[ \t]*$"
# Words that make a capitalised line a role.
ROLES = (
    "engineer", "manager", "director", "consultant", "analyst", "developer", "designer", "architect", "officer", "specialist", "assistant", "coordinator",
    "supervisor", "advisor", "administrator", "scientist", "accountant", "lawyer", "nurse", "doctor", "professor", "student", "intern", "technician",
    "operator", "lead", "head", "chief", "senior", "junior", "principal", "staff", "teacher", "researcher", "counsel",
)
# Capitalised phrases that are no persons; pass your own for your own documents.
STOP_PHRASES = (
    "acme analytics", "beta consulting", "gamma retail", "delta finance", "epsilon media", "zeta logistics", "eta retail", "theta health", "iota bank",
    "kappa manufacturing", "immobiliare sole", "supermarket milano", "trattoria da gino", "enel energia", "politecnico di milano", "via roma",
    "curriculum vitae", "personal details", "professional summary", "work experience", "opening balance", "closing balance", "total credits",
    "total debits", "value date", "card payment", "account holder", "account number", "mobile phone", "date of birth", "place of birth",
    "statement of account", "movements", "summary", "contacts", "experience", "education", "skills", "languages", "references", "notes", "holder",
    "salary january", "rent january", "transfer out", "utility bill", "tax id",
)
# Words that no name has.
STOP_TOKENS = (
    "ibm", "api", "sql", "cto", "ceo", "cv", "it", "uk", "usa", "eu", "vat", "id", "mobile", "email", "phone", "iban", "bic", "srl", "spa", "ltd", "gmbh",
    "sa", "ag", "python", "spark", "kafka", "airflow", "aws", "terraform", "january", "february",
)


def _any_of(words: Iterable[str], tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def is_role(value: Column) -> Column:
    """Holds a word for a role."""
    return _any_of(ROLES, F.transform(F.split(F.lower(strip(value)), rf"{WS}+"), lambda t: F.btrim(t, F.lit(".,"))))


def names(text: Column, validated: Column, stop_phrases: Iterable[str] = STOP_PHRASES, stop_tokens: Iterable[str] = STOP_TOKENS) -> Column:
    """Findings of kind PERSON: after a name label (0.9), before an @ (0.8), alone on a line if validated isn't empty (0.7).

    White space is collapsed; of names that differ in case only the first counts.
    """

    def all_of(pattern: str, group: int, guard: Column) -> Column:
        return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(nothing("array<string>"))

    def tagged(values: Column, confidence: float, why: str) -> Column:
        flat = F.transform(values, lambda v: strip(F.regexp_replace(v, rf"{WS}+", " ")))
        return F.transform(flat, lambda v: F.struct(v.alias("value"), F.lit(confidence).alias("confidence"), F.lit(why).alias("context")))

    labelled = F.transform(all_of(LABEL, 1, text.contains(":")), lambda v: F.btrim(v, F.lit(" \t.|,")))
    local = F.transform(all_of(EMAIL_LOCAL, 0, text.contains("@")), lambda v: F.translate(v, "._-", "   "))
    lines = all_of(LINE, 1, F.size(validated) > 0)
    alone = F.filter(lines, lambda v: ~is_role(v) & ~F.exists(lines, lambda o: (F.lower(o) != F.lower(v)) & F.startswith(F.lower(o), F.concat(F.lower(v), F.lit(" ")))))
    found = F.concat(tagged(labelled, 0.9, "explicit name label"), tagged(local, 0.8, "local part of an email address"), tagged(alone, 0.7, "capitalised entry in a document with structured PII"))
    stop = F.array(*[F.lit(p) for p in stop_phrases])

    def fine(f: Column) -> Column:
        low = F.lower(f["value"])
        return (low != "") & ~F.array_contains(stop, low) & ~_any_of(stop_tokens, F.transform(F.split(low, " "), lambda t: F.btrim(t, F.lit(".,"))))

    kind = "array<struct<value: string, confidence: double, context: string>>"
    first = F.aggregate(F.filter(found, fine), nothing(kind), lambda acc, f: F.when(F.exists(acc, lambda o: F.lower(o["value"]) == F.lower(f["value"])), acc).otherwise(F.concat(acc, F.array(f))))
    null = F.lit(None).cast("int")
    out = F.transform(first, lambda f: F.struct(F.lit("PERSON").alias("kind"), f["value"].alias("value"), null.alias("start"), null.alias("end"), f["context"].alias("context"), f["confidence"].alias("confidence"), F.lit("name_detector").alias("source")))
    return F.coalesce(out, nothing(FINDINGS))


def surname_hints(validated: Column) -> Column:
    """What fiscal codes say of a person's name: (kind, value, surname_letters, name_letters)."""
    codes = F.filter(validated, lambda s: (s["kind"] == "TAX_ID") & (F.length(s["value"]) >= 6))
    return F.transform(codes, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), F.upper(F.substring(s["value"], 1, 3)).alias("surname_letters"), F.upper(F.substring(s["value"], 4, 3)).alias("name_letters")))
