"""Keyed pseudonyms: HMAC-SHA256 of kind and value, by built-in functions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest of a binary column; the two pads are made on the driver and are as secret as the key."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def pseudonym(value: Column, kind: Column, salt: str | bytes, length: int = 6, style: str = "label") -> Column:
    """[KIND_TOKEN] (label), KIND_TOKEN (hash) or [REDACTED] (redact).

    Six hexadecimal digits tell some thousands of values apart; take 16 or more on
    a corpus.
    """
    if not salt:
        raise ValueError("a salt is needed: without one anyone can recompute the tokens")
    if style == "redact":
        return F.lit("[REDACTED]")
    key = salt.encode() if isinstance(salt, str) else salt
    token = F.upper(F.left(hmac_sha256(key, F.encode(F.concat(kind, F.lit(":"), value), "UTF-8")), F.lit(length)))
    tagged = F.concat(kind, F.lit("_"), token)
    if style == "hash":
        return tagged
    if style == "label":
        return F.concat(F.lit("["), tagged, F.lit("]"))
    raise ValueError(f"unknown style {style}")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def integrity_tag(payload: Column, key: bytes) -> Column:
    """HMAC of the JSON of a struct whose fields are given in order of name."""
    return hmac_sha256(key, F.encode(F.to_json(payload, {"ignoreNullFields": "false"}), "UTF-8"))


def integrity_tag_of(payload: dict, key: bytes) -> str:
    """The same of a Python value, on the driver."""
    import hmac

    return hmac.new(key, json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), hashlib.sha256).hexdigest()
