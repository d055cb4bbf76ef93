"""Normalisation and small text functions, as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .checksums import strip
from .patterns import ALIASES, KINDS, WS

#: The soft hyphen and characters without width.
INVISIBLE = "­​‌‍﻿"
_LETTER = r"[\p{L}\p{N}_]"


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Unicode canonical composition, which Spark lacks; ASCII texts don't leave the JVM's answer to Python.

    Python looks through a composed text once and gives it back; native tests for
    such texts by character classes take ten times as long.
    """
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(_composed(F.when(F.length(text) != F.octet_length(text), text)))


def tidy(text: Column) -> Column:
    """Everything of normalise() but composition: invisible characters, line ends, words broken over lines, trailing blanks, blank lines, ends."""
    t = F.translate(text, INVISIBLE, "")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, rf"({_LETTER})-\n({_LETTER})", "$1$2")
    t = F.regexp_replace(t, r"(?md)[ \t](?<![ \t][ \t])[ \t]*+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalise(text: Column) -> Column:
    """Text in composed form, with unified lines and without stray white space; null for null."""
    return tidy(nfc(text))


def canonical(text: Column, pages: Column) -> Column:
    """The text that is worked on: the text if there are no pages, the one page, or all pages after their markers."""
    marked = F.flatten(F.transform(pages, lambda p, i: F.array(F.format_string("<!-- page %d -->", i + 1), p)))
    n = F.coalesce(F.size(pages), F.lit(0))
    return F.when(n <= 0, F.coalesce(text, F.lit(""))).when(n == 1, F.get(pages, F.lit(0))).otherwise(F.array_join(marked, "\n\n", ""))


def finalised(text: Column, pages: Column) -> Column:
    """(text, pages, char_count): each of text and pages made from the other where that is missing."""
    t, p = F.coalesce(text, F.lit("")), F.coalesce(pages, F.array().cast("array<string>"))
    p2 = F.when((F.size(p) == 0) & (t != ""), F.array(t)).otherwise(p)
    t2 = F.when((t == "") & (F.size(p) > 0), F.array_join(p, "\n\n", "")).otherwise(t)
    return F.struct(t2.alias("text"), p2.alias("pages"), F.length(t2).cast("long").alias("char_count"))


def clip(text: Column, limit: int) -> Column:
    """The first 70 % and the last 30 % of limit characters, and a note of what lies between, if text is longer."""
    note = F.format_string("\n\n[... %d characters omitted ...]\n\n", F.length(text) - limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, int(limit * 0.7)), note, F.right(text, F.lit(int(limit * 0.3)))))


def kind_of(raw: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    """A label as one of the kinds; OTHER if it isn't one."""
    v = F.translate(F.upper(strip(F.coalesce(raw, F.lit("")))), " -", "__")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    v = F.coalesce(F.try_element_at(known, v), v)
    return F.when(v.isin(*KINDS), v).otherwise(F.lit("OTHER"))


def preview(value: Column, keep: int = 2) -> Column:
    """Stars for all but keep characters at each end, and for all of a short value."""
    n = F.length(value)
    return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(keep)), F.repeat(F.lit("*"), n - 2 * keep), F.right(value, F.lit(keep))))


def without_markup(markup: Column) -> Column:
    """Text with tags as spaces and white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(markup, r"<[^>]+>", " "), rf"{WS}+", " "))


def rendered(template: Column, values: Mapping[str, Column]) -> Column:
    """template with {{name}} replaced; unknown names stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v.cast("string"))
    return template


def estimated_tokens(text: Column) -> Column:
    """About four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def completion_budget(text: Column, requested: int, window: int, margin: int = 256, least: int = 256) -> Column:
    """Tokens to ask for so that prompt and answer fit the window; the request if no window is known."""
    if window <= 0:
        return F.lit(requested)
    room = F.lit(window - margin) - estimated_tokens(text)
    return F.when(room >= requested, F.lit(requested)).otherwise(F.greatest(F.lit(least), room))


def oversized(text: Column, requested: int, window: int) -> Column:
    """True if prompt and answer may not fit the window; never if no window is known."""
    return F.lit(False) if window <= 0 else estimated_tokens(text) + requested > window
