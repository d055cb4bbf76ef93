"""JSON and findings out of what a model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import strip
from .findings import FINDINGS, MISSING
from .scan import nothing
from .text import kind_of

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def json_of(text: Column) -> Column:
    """The first of these that parses, as an object: all of text, each fenced block, the outermost braces, the outermost brackets.

    Each is tried as it is and without trailing commas; what isn't an object
    becomes {"items": ...}.  Null if nothing parses.
    """
    whole = strip(text)

    def between(a: str, b: str) -> Column:
        start, end = F.instr(whole, a), F.length(whole) - F.instr(F.reverse(whole), b) + 1
        return F.when((start > 0) & (F.instr(whole, b) > 0) & (end > start), whole.substr(start, end - start + 1))

    tries = F.concat(F.array(whole), F.transform(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(1)), strip), F.array(between("{", "}"), between("[", "]")))
    both = F.flatten(F.transform(tries, lambda c: F.array(c, F.regexp_replace(c, r",(\s*[}\]])", "$1"))))
    good = F.filter(both, lambda c: (c != "") & F.try_parse_json(c).isNotNull())
    first = F.get(good, F.lit(0))
    return F.when(first.startswith("{"), first).otherwise(F.concat(F.lit('{"items": '), first, F.lit("}")))


def _string(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(F.try_variant_get(v, p, "string") != "", F.try_variant_get(v, p, "string")) for p in paths], F.lit(""))


def _confidence(v: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(default))))


def _objects(payload: Column, *names: str) -> Column:
    v = F.try_parse_json(payload)
    lists = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names], nothing("array<string>").cast("array<variant>"))
    return F.filter(lists, lambda e: F.schema_of_variant(e).startswith("OBJECT"))


def findings_of(payload: Column, source: str = "detector", default: float = 0.6) -> Column:
    """Findings in a payload's list findings or items; entries without a value are passed over, of equal (kind, value) the first counts."""
    def one(e: Column) -> Column:
        return F.struct(
            kind_of(_string(e, "$.kind", "$.type")).alias("kind"), strip(_string(e, "$.value", "$.text")).alias("value"), F.try_variant_get(e, "$.start", "int").alias("start"),
            F.try_variant_get(e, "$.end", "int").alias("end"), F.left(_string(e, "$.context"), F.lit(240)).alias("context"), _confidence(e, default).alias("confidence"), F.lit(source).alias("source"),
        )

    all_ = F.filter(F.transform(_objects(payload, "findings", "items"), one), lambda f: f["value"] != "")
    first = F.aggregate(all_, nothing(FINDINGS), lambda acc, f: F.when(F.exists(acc, lambda o: (o["kind"] == f["kind"]) & (o["value"] == f["value"])), acc).otherwise(F.concat(acc, F.array(f))))
    return F.coalesce(first, nothing(FINDINGS))


def names_of(payload: Column) -> Column:
    """Findings of kind PERSON in a payload's list names or findings."""
    null = F.lit(None).cast("int")
    one = lambda e: F.struct(F.lit("PERSON").alias("kind"), strip(_string(e, "$.value")).alias("value"), null.alias("start"), null.alias("end"), F.left(_string(e, "$.context"), F.lit(240)).alias("context"), _confidence(e, 0.75).alias("confidence"), F.lit("name_detector").alias("source"))
    return F.coalesce(F.filter(F.transform(_objects(payload, "names", "findings"), one), lambda f: f["value"] != ""), nothing(FINDINGS))


def critique_of(payload: Column) -> Column:
    """A review (functions.findings.CRITIQUE) out of a payload; all that is missing there is empty, 0 or false."""
    v = F.try_parse_json(payload)

    def values(name: str) -> Column:
        lists = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), nothing("array<string>").cast("array<variant>"))
        return F.transform(lists, lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT"), _string(e, "$.value")).otherwise(F.coalesce(F.try_variant_get(e, "$", "string"), F.lit(""))))

    missing = F.transform(_objects(payload, "missing"), lambda e: F.struct(_string(e, "$.kind").alias("kind"), _string(e, "$.value").alias("value"), _string(e, "$.context").alias("context"), _confidence(e, 0.6).alias("confidence")))
    wrong = F.transform(_objects(payload, "wrong_kind"), lambda e: F.struct(_string(e, "$.value").alias("value"), _string(e, "$.correct_kind").alias("kind")))
    return F.struct(
        F.coalesce(F.try_variant_get(v, "$.agreement_score", "double"), F.lit(0.0)).alias("agreement"), F.coalesce(F.try_variant_get(v, "$.accept", "boolean"), F.lit(False)).alias("accepted"),
        F.coalesce(missing, nothing(MISSING)).alias("missing"), values("false_positives").alias("false_positives"), values("over_masking").alias("over_masking"), values("feedback").alias("feedback"), wrong.alias("wrong_kind"),
    )
