"""Token sequences in training order, as binary shards of fixed stride.

Texts are tokenised and cut into sequences; a keyed Feistel permutation with
cycle-walking maps each sequence's place in the corpus to a global slot.  Slots are
dealt to shards by range, and every record has the same length, so a reader finds
slot s at byte (s mod PER_SHARD) * stride of shard s div PER_SHARD, reads on in
training order, and resumes anywhere.

A record: document id (8 bytes, little-endian), part (4), tokens (4), SEQUENCE token
ids of 2 bytes (4 for a vocabulary over 65,536) padded with zeros, and a line feed.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import positions
from ._store import park_path
from ._text import mix

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
SEQUENCE = 512
PER_SHARD = 4096
KEY = 20240229
#: What stands in a record for a null id.
NO_ID = -(1 << 63)
ROUNDS = 6


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The image of each x (0 to n - 1) under a keyed permutation of 0 to n - 1.

    A balanced Feistel network permutes the next power of four; values that land
    at n or over walk on along their cycle until they are back inside.
    """
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return (left << half) | right

    out = once(np.asarray(x, np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: dict[bytes, int] | None = None, pattern: str = PATTERN, end: int = END_OF_TEXT, length: int = SEQUENCE) -> DataFrame:
    """(id, part, n, ids): the tokens of each text and the end token, in parts of length tokens; ids are little-endian integers.

    A null or empty text has no sequence.  Special tokens in a text are ordinary text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks or load_ranks())  # one vocabulary
    kind = np.uint16 if _width(sent.value, end) == 2 else np.uint32

    def run(batches):
        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={}).encode_ordinary
        for b in batches:
            ids = b["id"].to_pylist()
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for i, t in zip(ids, b["text"]):
                t = t.as_py()
                if not t:
                    continue
                tokens = np.array([*encode(t), end], kind)
                for k in range(0, len(tokens), length):
                    part = tokens[k : k + length]
                    for c, v in zip(rows, (i, k // length, len(part), part.tobytes())):
                        c.append(v)
                if len(rows[0]) >= 4096:
                    yield _batch(rows)
                    rows = ([], [], [], [])
            yield _batch(rows)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, part int, n int, ids binary")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["id", "part", "n", "ids"])


def _width(ranks: dict[bytes, int], end: int) -> int:
    return 2 if max(max(ranks.values()), end) < 1 << 16 else 4


def _little(c: Column, size: int) -> Column:
    """A whole number as size little-endian bytes."""
    h = F.right(F.lpad(F.hex(c.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size))
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]))


def materialise(docs: DataFrame, id: str = "doc_id", text: str = "text", key: int = KEY, per_shard: int = PER_SHARD, length: int = SEQUENCE, **tokenizer) -> DataFrame:
    """(id, part, n, slot, shard, offset, record) of every sequence, in order of slot within partitions.

    The place of a sequence in the corpus is by id, then text, then part, so slots
    depend on the rows and the key only, not on partitions.  Null ids come first
    and are written as NO_ID; repeated rows each have their sequences; no rows give
    no records.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    order = [F.col("id"), F.xxhash64("text")]
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    table = sequences(rows.repartitionByRange(*order).sortWithinPartitions(*order), "id", "text", length=length, **tokenizer)
    path = park_path(table, "tokens", compression="zstd")
    placed = positions(spark, path, table.schema, "place")
    total, width = placed._rows, _width(tokenizer.get("ranks") or load_ranks(), tokenizer.get("end", END_OF_TEXT))

    @F.arrow_udf("long")
    def slot(place: pa.Array) -> pa.Array:
        return pa.array(feistel(place.to_numpy(), total, key))

    dealt = placed.withColumn("slot", slot("place")).withColumn("shard", F.expr(f"int(slot div {per_shard})"))
    dealt = dealt.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    head = F.concat(_little(F.coalesce("id", F.lit(NO_ID)), 8), _little(F.col("part"), 4), _little(F.col("n"), 4))
    record = F.concat(head, F.rpad("ids", F.lit(width * length), F.lit(b"\x00")), F.lit(b"\n"))
    out = dealt.select(F.col("id").alias(id), "part", "n", "slot", "shard", (F.expr(f"slot % {per_shard}") * (17 + width * length)).alias("offset"), record.alias("record"))
    out._records = total
    return out


def write_shards(docs: DataFrame, path: str, key: int = KEY, per_shard: int = PER_SHARD, length: int = SEQUENCE, **how) -> dict[str, int | str]:
    """Write one file for each shard under path/shard=k, and path/manifest; what the manifest says."""
    spark = docs.sparkSession
    rows = materialise(docs, key=key, per_shard=per_shard, length=length, **how)
    body = F.expr("substring(record, 1, length(record) - 1)").cast("string")  # the writer ends it with the line feed
    rows.select("shard", body.alias("value")).write.partitionBy("shard").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)
    ranks, end = how.get("ranks") or load_ranks(), how.get("end", END_OF_TEXT)
    said = {"records": rows._records, "per_shard": per_shard, "sequence": length, "width": _width(ranks, end), "vocabulary": len(ranks), "end": end, "key": key}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return said


def read_shards(spark: SparkSession, path: str, first: int = 0, end: int | None = None) -> DataFrame:
    """(slot, id, part, n, ids) of the slots from first to end (not included; default: all) of what write_shards wrote.

    Only shards that hold such slots are opened, and records are found by their
    place, so a reader resumes at any slot.  ids are as many whole numbers as the
    sequence has tokens; a null id comes back as null.
    """
    said = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    end = said["records"] if end is None else min(end, said["records"])
    per, kind, stride = said["per_shard"], np.dtype(f"<u{said['width']}"), 17 + said["width"] * said["sequence"]

    def run(batches):
        for b in batches:
            for shard, content in zip(b["shard"].to_pylist(), b["content"]):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                lo, hi = max(first - shard * per, 0), min(end - shard * per, len(raw))
                for at in range(lo, hi, 1024):
                    rows = raw[at : min(at + 1024, hi)]
                    ids, part, n = (np.ascontiguousarray(rows[:, a:e]).view(t)[:, 0] for a, e, t in ((0, 8, "<i8"), (8, 12, "<i4"), (12, 16, "<i4")))
                    tokens = np.ascontiguousarray(rows[:, 16:-1]).view(kind).astype(np.int32)
                    used = np.arange(said["sequence"]) < n[:, None]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(tokens[used]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard * per + at + np.arange(len(rows))), pa.array(ids, mask=ids == NO_ID), pa.array(part), pa.array(n), lists], ["slot", "id", "part", "n", "ids"])

    files = spark.read.format("binaryFile").option("basePath", path).load(f"{path}/shard=*")
    files = files.where(F.col("shard").between(first // per, (end - 1) // per)).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "slot long, id long, part int, n int, ids array<int>")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return materialise(docs).select("doc_id", "part", F.col("n").alias("n_tokens"), "slot", "shard", "offset", F.crc32("record").alias("record_crc32"))
