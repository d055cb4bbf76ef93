import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.pseudonyms import hmac_sha256, integrity_tag_of, pseudonym


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def plain(t):
    t = unicodedata.normalize("NFC", t)
    t = re.sub("[­​‌‍﻿]", "", t).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(?m)[ \t]+$", "", re.sub(r"(\w)-\n(\w)", r"\1\2", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@pytest.mark.parametrize("t", ["", "  a \r\n\r\n\r\nb\r", "é ­​x", "a-\nb-\nc-\nd", "x \u2028 \ny\t\n", "\x1c\x85 z  ", "wort-\nende é-\né", "a" * 100_000 + " \n" * 50])
def test_normalise(spark, t):
    assert one(spark, T.normalise(F.col("t")), t=t) == plain(t)


def test_long_runs_of_blanks(spark):
    """A megabyte of them, each run looked at once."""
    t = "x" + " \t" * 500_000 + "y" + " " * 500_000 + "\nz" + " " * 500_000
    assert one(spark, T.normalise(F.col("t")), t=t) == "x" + " \t" * 500_000 + "y\nz"


def test_null_stays_null(spark):
    assert one(spark, T.normalise(F.col("t")), t=None) is None
    assert one(spark, T.clip(F.col("t"), 5), t=None) is None


def test_canonical(spark):
    c = T.canonical(F.col("t"), F.col("p"))
    assert one(spark, c, t="x", p=[]) == "x"
    assert one(spark, c, t="x", p=["y"]) == "y"
    assert one(spark, c, t="x", p=["y", "z"]) == "<!-- page 1 -->\n\ny\n\n<!-- page 2 -->\n\nz"
    assert one(spark, c, t=None, p=[None]) is None


def test_clip(spark):
    assert one(spark, T.clip(F.col("t"), 10), t="0123456789") == "0123456789"
    assert one(spark, T.clip(F.col("t"), 10), t="0123456789ab") == "0123456\n\n[... 2 characters omitted ...]\n\n9ab"


@pytest.mark.parametrize("raw,want", [("full name", "PERSON"), ("E-Mail", "EMAIL"), ("PAN", "CREDIT_CARD"), ("nonsense-label", "OTHER"), ("", "OTHER"), (None, "OTHER"), (" iban ", "IBAN"), ("URL", "OTHER")])
def test_kinds(spark, raw, want):
    assert one(spark, T.kind_of(F.col("t")), t=raw) == want


@pytest.mark.parametrize("v,want", [("", ""), ("abcd", "****"), ("abcde", "ab*de")])
def test_preview(spark, v, want):
    assert one(spark, T.preview(F.col("t")), t=v) == want


def test_markup_and_templates(spark):
    assert one(spark, T.without_markup(F.col("t")), t="<p>a\n<b>b</b></p>") == "a b"
    assert one(spark, T.rendered(F.col("t"), {"a": F.lit(1)}), t="{{a}} {{b}}") == "1 {{b}}"


def test_pseudonyms(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        assert one(spark, hmac_sha256(key, F.encode("t", "UTF-8")), t="é") == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    token = hmac.new(b"test-salt", b"PERSON:Mario Rossi", hashlib.sha256).hexdigest()[:6].upper()
    p = lambda style: one(spark, pseudonym(F.col("t"), F.lit("PERSON"), "test-salt", style=style), t="Mario Rossi")
    assert (p("label"), p("hash"), p("redact")) == (f"[PERSON_{token}]", f"PERSON_{token}", "[REDACTED]")
    with pytest.raises(ValueError):
        pseudonym(F.col("t"), F.lit("X"), "")
    assert len(integrity_tag_of({"b": 1, "a": "é"}, b"k")) == 64
