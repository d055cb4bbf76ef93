import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checksums as C

VECTORS = [
    (C.luhn_ok, ["4111 1111 1111 1111", "5500005555555559", "0000000000000000"], ["4111 1111 1111 1112", "1234", "", None]),
    (C.iban_ok, ["IT60X0542811101000000123456", "DE89370400440532013000", "de89 3704 0044 0532 0130 00"], ["IT60X0542811101000000123457", "DE89", "", None]),
    (C.fiscal_code_ok, ["RSSMRA85C14F205Z", " rssmra85c14f205z "], ["not a fiscal code", "", None]),
    (C.fiscal_code_checked, ["RSSMRA80A01H501U"], ["RSSMRA85C14F205Z", "", None]),
    (C.nif_ok, ["12345678Z"], ["12345678A", "X1234567L", "Z", "", None]),
    (C.ipv4_ok, ["192.168.1.1", "001.002.003.255"], ["999.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "", None]),
]


@pytest.mark.parametrize("check,good,bad", VECTORS, ids=lambda v: getattr(v, "__name__", ""))
def test_vectors(spark, check, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert df.where(check(F.col("v")) != F.col("want")).collect() == []
