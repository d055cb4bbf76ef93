import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions.scan import candidates, matches, scan
from palimpsest.plans.sanitise import Settings, sanitised

CV = """Curriculum Vitae

Name: Mario Rossi
Email: mario.rossi@example.com
Mobile: +39 333 1234567
Date of birth: 14/03/1985
Fiscal code: RSSMRA85C14F205Z
IBAN: IT60X0542811101000000123456
Via Roma 42
Data Engineer, 2019-2024
Mario Rossi
"""


def spans(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [[tuple(s) for s in r.s] for r in df.select("i", scan(F.col("t")).alias("s")).orderBy("i").collect()]


def test_worked_example(spark):
    (found,) = spans(spark, CV)
    assert [(k, v) for k, v, *_ in found] == [
        ("EMAIL", "mario.rossi@example.com"), ("PHONE", "+39 333 1234567"), ("DOB", "14/03/1985"), ("TAX_ID", "RSSMRA85C14F205Z"),
        ("IBAN", "IT60X0542811101000000123456"), ("PHONE", "2019-2024"),
    ]
    assert found[3][4:] == (0.85, "codice_fiscale_shape")


def test_spans_are_disjoint_and_say_what_stands_there(spark):
    text = "😀 x@y.com, è 10.0.0.1 4111 1111 1111 1111 2024-01-05 https://a.example/b?c. AB123CD IT12345678901 123-45-6789 1:2:3:4"
    (found,) = spans(spark, text)
    for (_, v, a, b, *_), (*_, c, _, _, _) in zip(found, found[1:]):
        assert b <= c
    assert all(text[a:b] == v for _, v, a, b, *_ in found)


def test_defined_cases(spark):
    assert spans(spark, None, "", "   ", "no digits here", "x" * 300_000) == [[], [], [], [], []]
    # a date has the shape of a phone number, which is surer; a clock has that of an address
    assert [s[0] for s in spans(spark, "on 2024-01-05")[0]] == ["PHONE"]
    assert [s[0] for s in spans(spark, "at 12:34:56")[0]] == ["IP_ADDRESS"]
    # spaced numbers are no IBANs; a zero card passes its check
    assert [s[0] for s in spans(spark, "DE89 3704 0044 0532 0130 00")[0]] != ["IBAN"]
    assert [s[0] for s in spans(spark, "0000 0000 0000 0000")[0]] == ["CREDIT_CARD"]


def test_addresses_of_letters_alone(spark):
    texts = ["gateway dead:beef:cafe, adapter aa:bb:cc:dd:ee:ff", "Carlo Verdi\nFE:ED:BE:EF\n", "a:b", "no: colon shape"]
    found = spans(spark, *texts)
    assert [[s[:2] for s in f] for f in found] == [[("IP_ADDRESS", "dead:beef:cafe"), ("IP_ADDRESS", "aa:bb:cc:dd:ee:ff")], [("IP_ADDRESS", "FE:ED:BE:EF")], [], []]
    out = sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Settings(salt="x")).orderBy("doc_id").collect()
    assert not any(v in r.cleaned_text for r in out for v in ("dead:beef", "aa:bb", "FE:ED", "Carlo Verdi")) and out[2].cleaned_text == "a:b"


def test_many_matches_in_one_text(spark):
    (found,) = spans(spark, "a@b.co " * 3000)
    assert len(found) == 3000 and found[-1][2] == 7 * 2999


PYTHON = {"email": P.EMAIL, "phone": P.PHONE, "date": P.DATE, "card": P.CARD, "plate": P.PLATE_IT, "url": P.URL, "ipv6": P.IPV6}
ALPHABET = "01239 -./:()+@aJANbéİſ_~😀\n\t IT€"


def test_against_another_regex_engine(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", *[matches(F.col("t"), p).alias(n) for n, p in PYTHON.items()]).collect():
        for n, p in PYTHON.items():
            shape = p.replace("(?U:\\b)", r"\b").replace("(?iu)", "(?i)")
            assert [tuple(m) for m in r[n]] == [(m[0], m.start(), m.end()) for m in re.finditer(shape, texts[r.i])], (n, texts[r.i])


def test_extra_scanners_are_off_by_default(spark):
    df = spark.createDataFrame([("AA1234567 lives in 20100",)], "t string")
    assert spans(spark, "lives in 20100") == [[]]
    (row,) = df.select(candidates(F.col("t"), P.EXTRA).alias("c")).collect()
    assert {c.kind for c in row.c} == {"PASSPORT", "ADDRESS"}


def test_matches_over_several_chunks(spark):
    for n in (255, 256, 257, 513):
        text = " ".join(f"u{k}@x.it" for k in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(scan(F.col("t")).alias("s")).first().s
        assert [(s.value, s.start, s.end) for s in got] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
