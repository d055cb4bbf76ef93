"""The scan for SQL users: SELECT * FROM pii_spans('text').

A Python kernel with the same shapes and checks as functions.scan; inside plans the
column functions are the faster way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checksums import ALPHABET, NIF_LETTERS, ODD_WEIGHTS
from .patterns import CARD, SCANNERS


def _python(pattern: str) -> str:
    """A shape of functions.patterns in Python's dialect."""
    return pattern.replace(r"(?U:\b)", r"\b").replace("(?iu)", "(?i)")


_CARD = re.compile(_python(CARD))


def _luhn(v: str) -> bool:
    d = [int(c) for c in v if c in "0123456789"][::-1]
    return len(d) > 12 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _iban(v: str) -> bool:
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _fiscal(v: str) -> bool:
    places = [ALPHABET.find(c) if c in ALPHABET else int(c) for c in v.upper()]
    return sum(p if k % 2 else ODD_WEIGHTS[p] for k, p in enumerate(places[:15])) % 26 == places[15]


def _nif(v: str) -> bool:
    return v[:-1].isdigit() and NIF_LETTERS[int(v[:-1]) % len(NIF_LETTERS)] == v[-1]


def _ipv4(v: str) -> bool:
    return max(map(int, v.split("."))) < 256


def _phone(v: str) -> bool:
    return 8 <= sum(c in "0123456789" for c in v) <= 15 and not _CARD.fullmatch(v.strip())


_CHECKS = {"luhn": _luhn, "iban": _iban, "nif": _nif, "ipv4": _ipv4, "phone": _phone}
_SHAPES = [(s, re.compile(_python(s.pattern))) for s in SCANNERS]


def spans(text: str | None) -> list[tuple[str, str, int, int, float, str]]:
    """(kind, value, start, end, confidence, reason) without overlaps, as functions.scan.scan gives them."""
    found = []
    for rank, (s, shape) in enumerate(_SHAPES):
        for m in shape.finditer(text or ""):
            if s.gate in _CHECKS and not _CHECKS[s.gate](m[0]):
                continue
            sure, why = (0.98, "codice_fiscale_checksum") if s.gate == "cf" and _fiscal(m[0]) else (s.confidence, s.reason)
            found.append((m.start(), -len(m[0]), -sure, rank, (s.kind, m[0], m.start(), m.end(), sure, why)))
    out, end = [], 0
    for start, *_, span in sorted(found):
        if start >= end:
            out.append(span)
            end = span[3]
    return out


class PiiSpans:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from spans(text)


def register(spark: SparkSession, name: str = "pii_spans") -> None:
    """Make the table function known to a session."""
    spark.udtf.register(name, F.udtf(PiiSpans, returnType="kind string, value string, start int, end int, confidence double, reason string"))
