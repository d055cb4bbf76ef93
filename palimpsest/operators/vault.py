"""Encryption at rest, key rotation and retention, as column functions and plans.

A token is what the public Fernet specification says: version byte, time, AES-128
in CBC mode with its initialisation vector, and an HMAC over all of them, in
URL-safe base64.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pseudonyms import hmac_sha256


class VaultError(RuntimeError):
    """A key is missing or isn't one."""


def generate_key() -> str:
    return base64.urlsafe_b64encode(os.urandom(32)).decode()


def key_from_passphrase(passphrase: str, salt: bytes, rounds: int = 200_000) -> str:
    """The same key for the same passphrase and salt, by PBKDF2-HMAC-SHA256."""
    return base64.urlsafe_b64encode(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, dklen=32)).decode()


def read_keys(*sources: str, inline: Sequence[str] = ()) -> list[str]:
    """Keys given inline, then those from the lines of key files; lines that are empty or begin with # are passed over."""
    keys = [k.strip() for k in inline]
    for path in sources:
        with open(path, encoding="utf-8") as f:
            keys += [s for line in f if (s := line.strip()) and not s.startswith("#")]
    return keys


def _halves(key: str | None) -> tuple[bytes, bytes]:
    if not key:
        raise VaultError("a key is needed: nothing is written in the clear instead")
    try:
        raw = base64.urlsafe_b64decode(key)
    except ValueError as e:
        raise VaultError("the key isn't URL-safe base64") from e
    if len(raw) != 32:
        raise VaultError("the key must hold 32 bytes")
    return raw[:16], raw[16:]


def encrypted(df: DataFrame, column: str, key: str | None, into: str | None = None) -> DataFrame:
    """df with a token of the binary or string column; null stays null.  Without a valid key this raises before anything is planned."""
    sign, secret = _halves(key)
    data = F.encode(F.col(column), "UTF-8") if dict(df.dtypes)[column] == "string" else F.col(column)
    # the vector must be drawn once: Spark doesn't merge a random column into its uses
    rows = df.withColumn("__iv", F.unhex(F.md5(F.concat(F.expr("uuid()"), F.expr("uuid()")))))
    time = F.unhex(F.lpad(F.hex(F.unix_timestamp()), 16, "0"))
    body = F.concat(F.lit(b"\x80"), time, F.aes_encrypt(data, F.lit(secret), F.lit("CBC"), F.lit("PKCS"), F.col("__iv")))
    rows = rows.withColumn("__body", body)
    token = F.base64(F.concat("__body", F.unhex(hmac_sha256(sign, F.col("__body")))))
    return rows.withColumn(into or column, F.translate(token, "+/\r\n", "-_")).drop("__iv", "__body")


def decrypted(token: Column, key: str | None) -> Column:
    """Bytes of a token, null if the key isn't its key or it was altered."""
    sign, secret = _halves(key)
    raw = F.try_to_binary(F.translate(token.cast("string"), "-_", "+/"), F.lit("base64"))
    n = F.length(raw)
    body, tag = raw.substr(F.lit(1), n - 32), raw.substr(n - 31, F.lit(32))
    fits = (n >= 73) & (raw.substr(F.lit(1), F.lit(1)) == F.lit(b"\x80")) & (F.unhex(hmac_sha256(sign, body)) == tag)
    return F.when(fits, F.try_aes_decrypt(raw.substr(F.lit(10), n - 41), F.lit(secret), F.lit("CBC"), F.lit("PKCS")))


def opened(files: DataFrame, key: str | None, suffix: str = ".enc") -> DataFrame:
    """(path, content) of files (path, content: binary), decrypted; content is null where the key doesn't open it.

    Of a file with the suffix and one of the same name without it the first
    counts; path is the name without it.  Contents aren't shuffled if the names of
    the files with the suffix fit a broadcast.
    """
    rows = files.select("path", "content")
    sealed = rows.where(F.col("path").endswith(suffix)).withColumn("path", F.expr(f"left(path, length(path) - {len(suffix)})"))
    plain = rows.where(~F.col("path").endswith(suffix)).join(sealed.select("path"), "path", "left_anti")
    return sealed.unionAll(plain).select("path", decrypted(F.col("content").cast("string"), key).alias("content"))


def artifacts(jobs: DataFrame, key: str | None, job: str = "job_id", cleaned: str = "cleaned_text", report: str = "report_md", result: str = "result_json", created: str = "created_at") -> DataFrame:
    """(job_id, artifact, ciphertext, created_at): result, report and, if there is any, cleaned text of each job, failed ones included."""
    parts = F.array(
        F.struct(F.lit("result").alias("artifact"), F.col(result).alias("content")), F.struct(F.lit("cleaned_text").alias("artifact"), F.col(cleaned).alias("content")),
        F.struct(F.lit("report").alias("artifact"), F.col(report).alias("content")),
    )
    flat = jobs.select(F.col(job).alias("job_id"), F.col(created).alias("created_at"), F.explode(parts).alias("p")).select("job_id", "created_at", "p.*")
    flat = flat.where((F.col("artifact") != "cleaned_text") | (F.coalesce(F.col("content"), F.lit("")) != ""))
    return encrypted(flat, "content", key, "ciphertext").select("job_id", "artifact", "ciphertext", "created_at")


def rotated(stored: DataFrame, key: str, old: Sequence[str], purge: bool = False, column: str = "ciphertext") -> DataFrame:
    """stored with status: skipped (the key opens it), migrated (an old one does, and it is encrypted anew), failed or, to be purged, purged."""
    now = decrypted(F.col(column), key).isNotNull()
    rows = stored.withColumn("__plain", F.coalesce(*[decrypted(F.col(column), k) for k in old]) if old else F.lit(None).cast("binary"))
    lost = F.lit("purged" if purge else "failed")
    rows = rows.withColumn("status", F.when(now, F.lit("skipped")).when(F.col("__plain").isNotNull(), F.lit("migrated")).otherwise(lost))
    rows = encrypted(rows, "__plain", key, "__new")
    return rows.withColumn(column, F.when(F.col("status") == "migrated", F.col("__new")).otherwise(F.col(column))).drop("__plain", "__new")


def tally(rows: DataFrame) -> DataFrame:
    """(status, n); of rotated(), this is a dry run's report, as nothing is written."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def written(rows: DataFrame, path: str) -> None:
    """Write what rotated() keeps; purged rows go."""
    rows.where("status <> 'purged'").drop("status").write.parquet(path)


def unexpired(df: DataFrame, minutes: float, created: str = "created_at", now: Column | None = None) -> DataFrame:
    """Rows not older than minutes; a null time is kept, as nothing says it is old."""
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(created).isNull() | (F.col(created) >= now - F.make_dt_interval(mins=F.lit(int(minutes)))))


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def download(jobs: DataFrame, job_id: str, kind: str = "cleaned") -> DataFrame:
    """The cleaned text or the report of a finished job."""
    columns = {"cleaned": "cleaned_text", "report": "report_md"}
    if kind not in columns:
        raise ValueError(f"kind must be one of {sorted(columns)}")
    return job(jobs, job_id).where("status = 'done'").select(columns[kind])
