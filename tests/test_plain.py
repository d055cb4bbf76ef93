"""The whole way, held against a plain implementation."""

import hashlib
import hmac
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import names as N
from palimpsest.functions.scan import scan
from palimpsest.functions.udtf import register, spans
from palimpsest.plans.sanitise import Settings, sanitised

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_names(text, some):
    strip_words = lambda v: [w.strip(".,").lower() for w in v.split()]
    lines = re.findall(N.LINE.replace("(?md)", "(?m)"), text) if some else []
    alone = [v for v in lines if not set(strip_words(v)) & set(N.ROLES) and not any(o.lower() != v.lower() and o.lower().startswith(v.lower() + " ") for o in lines)]
    local = [re.sub("[._-]", " ", v) for v in re.findall(N.EMAIL_LOCAL.replace(r"[\p{L}\p{N}_.]", r"[\w.]"), text)]
    out = {}
    for v, sure in [*((v.strip(" \t.|,"), 0.9) for v in re.findall(N.LABEL.replace("(?imud)", "(?im)"), text)), *((v, 0.8) for v in local), *((v, 0.7) for v in alone)]:
        v = " ".join(v.split())
        if v and v.lower() not in N.STOP_PHRASES and not set(strip_words(v)) & set(N.STOP_TOKENS):
            out.setdefault(v.lower(), (v, sure))
    return list(out.values())


def plain_masked(text, salt):
    found = spans(text)
    values = {}
    for kind, v, sure in [*((s[0], s[1], s[4]) for s in found), *(("PERSON", v, sure) for v, sure in plain_names(text, found))]:
        if v in text:
            values[kind, v] = max(sure, values.get((kind, v), 0))
    n = 0
    for (kind, v), _ in sorted(values.items(), key=lambda x: (-len(x[0][1]), -x[1], x[0])):
        if v in text:
            token = hmac.new(salt.encode(), f"{kind}:{v}".encode(), hashlib.sha256).hexdigest()[:6].upper()
            text, n = text.replace(v, f"[{kind}_{token}]"), n + 1
    return text, n


def made(n):
    """Texts full of things to be found."""
    rng = random.Random(11)
    parts = [
        lambda: "Name: " + rng.choice(["Ada Byron", "ada  byron|x", "IBM Italia", "É Zola", "Curriculum Vitae"]), lambda: rng.choice(["Carlo Verdi", "Senior Analyst", "Carlo Verdi Neri", "Via Roma"]),
        lambda: rng.choice(["john.smith@x.example", "a_b@c.it", "é.x@y.zz", "x@y"]), lambda: f"{rng.randrange(10**16):016d}", lambda: "4111 1111 1111 1111 ", lambda: f"10.{rng.randrange(300)}.0.1",
        lambda: f"{rng.randrange(40)}/{rng.randrange(13)}/{rng.randrange(3000)}", lambda: "3 March 1999", lambda: f"+39 {rng.randrange(1000)} {rng.randrange(10**7)}", lambda: "IT60X0542811101000000123456",
        lambda: f"{rng.randrange(10**8):08d}{rng.choice('TRWAGMYF')}", lambda: "123-45-6789", lambda: "AB 123 CD", lambda: "https://e.example/a?b=c.", lambda: "fe80:0:1:2", lambda: "RSSMRA80A01H501U", lambda: "IT12345678901",
        lambda: "PERSON", lambda: "word", lambda: "日本 ٣٤٥ ſ", lambda: "12:34:56",
    ]
    return ["".join(rng.choice(parts)() + rng.choice([" ", "\n", ", ", "\n\n", "\u2028"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    out = [*made(400), "", " "]
    if os.path.exists(SF):
        out += [r.text for r in spark.read.parquet(SF).select("text").collect()]
    return out


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_scan(rows, texts):
    for r in rows.select("id", scan(F.col("text")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == spans(texts[r.id]), texts[r.id]


def test_sanitised(rows, texts):
    for r in sanitised(rows, Settings(salt="k")).select("id", "cleaned_text", "total_masked").collect():
        assert (r.cleaned_text, r.total_masked) == plain_masked(texts[r.id], "k"), texts[r.id]


def test_table_function(spark):
    register(spark)
    got = spark.sql("SELECT s.* FROM VALUES ('mail a@b.co'), (CAST(NULL AS STRING)) t(x), LATERAL pii_spans(x) s").collect()
    assert [tuple(r) for r in got] == [("EMAIL", "a@b.co", 5, 11, 0.99, "regex")]
