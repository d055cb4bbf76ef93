"""Check digits and validity rules, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BLANKS, WS

# Letters and weights of the public rules.
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD_WEIGHTS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
CF_SHAPE = r"^[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]$"


def strip(c: Column) -> Column:
    """Without white space at either end, in Python's sense of it."""
    return F.btrim(c, F.lit(BLANKS))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c worked out once, however often use names it; inside lambdas Spark doesn't see repetitions."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _position(alphabet: str, c: Column) -> Column:
    """Place of a character in alphabet from 0, -1 if it isn't there."""
    return F.position(c, F.lit(alphabet)) - 1


def luhn_ok(c: Column) -> Column:
    """At least 13 digits, and their Luhn sum is a multiple of ten; what isn't a digit is passed over."""

    def check(digits: Column) -> Column:
        odd = F.size(digits) % 2

        def add(a: Column, x: Column) -> Column:
            n = x.cast("int")
            worth = F.when(a["i"] % 2 != odd, n).when(n > 4, 2 * n - 9).otherwise(2 * n)
            return F.struct((a["i"] + 1).alias("i"), (a["sum"] + worth).alias("sum"))

        return F.aggregate(digits, F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")), add, lambda a: (a["i"] >= 13) & (a["sum"] % 10 == 0))

    return F.coalesce(bound(_characters(F.regexp_replace(c, "[^0-9]", "")), check), F.lit(False))


def iban_ok(c: Column) -> Column:
    """Shape, length 15 to 34 and remainder 1 modulo 97, white space aside; the number is folded, as it exceeds any decimal."""

    def fold(a: Column, x: Column) -> Column:
        n = _position("0123456789" + ALPHABET, x)
        return F.pmod(F.when(n > 9, a * 100).otherwise(a * 10) + n, F.lit(97))

    def check(v: Column) -> Column:
        shape = F.length(v).between(15, 34) & v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
        moved = _characters(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)))
        return F.when(shape, F.aggregate(moved, F.lit(0), fold) == 1).otherwise(F.lit(False))

    return F.coalesce(bound(F.upper(F.regexp_replace(c, WS, "")), check), F.lit(False))


def fiscal_code_ok(c: Column) -> Column:
    """Has the shape of an Italian fiscal code."""
    return F.coalesce(F.upper(strip(c)).rlike(CF_SHAPE), F.lit(False))


def fiscal_code_checked(c: Column) -> Column:
    """Has the shape and the right check letter."""
    odd = F.array(*[F.lit(w) for w in ODD_WEIGHTS])

    def check(v: Column) -> Column:
        def weight(i: Column) -> Column:
            return bound(v.substr(i + 1, F.lit(1)), lambda x: bound(F.coalesce(x.try_cast("int"), _position(ALPHABET, x)), lambda n: F.when(i % 2 == 0, F.get(odd, n)).otherwise(n)))

        total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda a, i: a + weight(i))
        return F.when(v.rlike(CF_SHAPE), F.lit(ALPHABET).substr(total % 26 + 1, F.lit(1)) == v.substr(F.lit(16), F.lit(1))).otherwise(F.lit(False))

    return F.coalesce(bound(F.upper(strip(c)), check), F.lit(False))


def nif_ok(c: Column) -> Column:
    """Digits and the letter that their remainder modulo 23 stands for; a leading letter fails."""
    v = F.upper(strip(c))
    body = F.left(v, F.length(v) - 1)
    rest = F.pmod(body.try_cast("decimal(38,0)"), F.lit(23)).cast("int")
    return F.coalesce(body.rlike("^[0-9]+$") & (F.lit(NIF_LETTERS).substr(rest + 1, F.lit(1)) == F.right(v, F.lit(1))), F.lit(False))


def ipv4_ok(c: Column) -> Column:
    """Four parts of 0 to 255; leading zeros are fine."""
    parts = F.split(c, r"\.", -1)
    fits = F.forall(parts, lambda p: p.rlike("^[0-9]+$") & (p.try_cast("decimal(38,0)") <= 255))
    return F.coalesce((F.size(parts) == 4) & fits, F.lit(False))
