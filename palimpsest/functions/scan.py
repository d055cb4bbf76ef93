"""Finding personal data in a text column, natively."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import fiscal_code_checked, fiscal_code_ok, iban_ok, ipv4_ok, luhn_ok, nif_ok, strip
from .patterns import CARD, SCANNERS, Scanner

SPAN = "array<struct<kind: string, value: string, start: int, end: int, confidence: double, reason: string>>"
_ORDERED = "array<struct<start: int, shorter: int, unsure: double, scanner: int, kind: string, value: string, end: int, confidence: double, reason: string>>"


def nothing(kind: str) -> Column:
    """An empty array of the given type."""
    return F.from_json(F.lit("[]"), kind)


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, chunk: int = 256) -> Column:
    """(state, out) after step(acc, item) for each item, where acc is of state and out, an array of the given type that step appends to.

    An array that grows is copied at each step, so items are taken in chunks, whose
    arrays are joined at the end: work grows with the items, not with their square.
    """
    once = F.array(F.struct(items.alias("items")))  # worked out once: a lambda would do it again at each chunk

    def chunks(o: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(o["items"]) / chunk).cast("int")), lambda k: F.slice(o["items"], k * chunk + 1, chunk))

    def of_chunk(acc: Column, part: Column) -> Column:
        done = lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs"))
        return F.aggregate(part, F.struct(acc["state"].alias("state"), nothing(kind).alias("out")), step, done)

    def whole(o: Column) -> Column:
        empty = F.struct(start.alias("state"), nothing(f"array<{kind}>").alias("outs"))
        return F.aggregate(chunks(o), empty, of_chunk, lambda a: F.struct(a["state"].alias("state"), F.flatten(a["outs"]).alias("out")))

    return F.get(F.transform(once, whole), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of all matches, ends exclusive, in characters.

    Spark has no function for the places of matches: what stands between them
    (split) and they themselves (extract all) add up to them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))), lambda v, gap: F.struct(v.alias("value"), F.length(gap).alias("gap")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    kind = "array<struct<value: string, start: int, end: int>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["state"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("state"), F.concat(acc["out"], F.array(F.struct(p["value"].alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

    return folded(pairs, F.lit(0), step, kind)["out"]


def phone_ok(v: Column) -> Column:
    """8 to 15 digits, and not the shape of a card number as a whole."""
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15) & ~strip(v).rlike(rf"\A(?:{CARD})\z")


_GATES = {"iban": iban_ok, "luhn": luhn_ok, "cf": fiscal_code_ok, "nif": nif_ok, "ipv4": ipv4_ok, "phone": phone_ok}


def candidates(text: Column, scanners: Iterable[Scanner] = SCANNERS) -> Column:
    """All matches of all scanners that pass their checks, each with its place in the order of precedence."""
    return F.concat(*[_of_scanner(text, s, k) for k, s in enumerate(scanners)])


def _of_scanner(text: Column, s: Scanner, k: int) -> Column:
    def span(m: Column) -> Column:
        checked = fiscal_code_checked(m["value"]) if s.gate == "cf" else F.lit(False)
        sure = F.when(checked, F.lit(0.98)).otherwise(F.lit(s.confidence))
        why = F.when(checked, F.lit("codice_fiscale_checksum")).otherwise(F.lit(s.reason))
        return F.struct(
            m["start"].alias("start"), (m["start"] - m["end"]).alias("shorter"), (-sure).alias("unsure"), F.lit(k).alias("scanner"), F.lit(s.kind).alias("kind"),
            m["value"].alias("value"), m["end"].alias("end"), sure.alias("confidence"), why.alias("reason"),
        )

    found = matches(text, s.pattern)
    if s.gate:
        found = F.filter(found, lambda m: _GATES[s.gate](m["value"]))
    likely = text.rlike(s.pattern) if not s.needs else text.contains(s.needs) & text.rlike(s.pattern)
    return F.when(likely, F.transform(found, span)).otherwise(nothing(_ORDERED))


def resolve_overlaps(spans: Column) -> Column:
    """Of spans in the order of precedence, those that overlap none kept before: by start, then the longer, the surer, the earlier scanner."""

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["state"]
        one = F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence"), x["reason"].alias("reason"))
        return F.when(free, F.struct(x["end"].alias("state"), F.concat(acc["out"], F.array(one)).alias("out"))).otherwise(acc)

    return folded(F.array_sort(spans), F.lit(0), step, SPAN)["out"]


def scan(text: Column, scanners: Iterable[Scanner] = SCANNERS) -> Column:
    """array of (kind, value, start, end, confidence, reason) without overlaps, by start; empty for null."""
    scanners = tuple(scanners)
    digit_or_sign = text.rlike("[0-9@:]")  # each shape, those of EXTRA included, needs a digit, an @ or, as URL and IPV6 (which may be letters alone), a colon
    return F.when(text.isNotNull() & digit_or_sign, resolve_overlaps(candidates(text, scanners))).otherwise(nothing(SPAN))
