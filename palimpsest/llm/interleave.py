"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; all rows are then
sorted by fractional rank, (rank + 1/2) / rows of the source, and cut into shards
whose counts are at most one apart.  Any stretch of that order holds every source
in proportion, so every shard matches the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import numbered
from ._store import drop, drop_path, park, small, unused


def interleave(docs: DataFrame, shards: int = 16, source: str = "source", seed: int = 17) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot, the row's place in its shard from 0.

    Which row goes where depends on the rows, the seed and the number of shards
    alone, not on partitions; rows equal in all columns may change places.  Null is
    a source of its own.  Nulls and repeated rows count like all others; an empty
    table gives no rows, fewer rows than shards leave shards empty.  Columns named
    shard and slot are replaced, all others stay whatever their names.
    """
    docs = docs.drop("shard", "slot")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    group, key, tie, pos, share, at, name, lo, n = (unused(docs, c) for c in ("source", "key", "tie", "pos", "share", "at", "name", "lo", "n"))
    own = F.col(f"`{source}`")
    keyed = docs.select(*cols, F.xxhash64(F.lit(seed), own.cast("string")).alias(group), F.xxhash64(F.lit(seed), *cols).alias(key))
    keyed = keyed.withColumn(tie, F.monotonically_increasing_id())  # equal rows needn't meet in one task
    ranked, first = numbered(keyed, [F.col(group), own, F.col(key), F.col(tie)], pos)
    bounds = park(ranked.groupBy(group, own.alias(name)).agg(F.min(pos).alias(lo), F.count("*").alias(n)), "sources")
    total = bounds.agg(F.sum(n)).first()[0] or 0
    other = group + "_"
    mixed = ranked.join(small(bounds.withColumnRenamed(group, other)), (F.col(group) == F.col(other)) & own.eqNullSafe(F.col(name)))
    mixed = mixed.select(*cols, ((2 * (F.col(pos) - F.col(lo)) + 1) / (2 * F.col(n))).alias(share), group, pos)
    placed, _ = numbered(mixed, [F.col(share), F.col(group), F.col(pos)], at)
    out = placed.withColumn("shard", F.expr(f"int(({at} * {shards}) div {max(total, 1)})"))
    out = out.withColumn("slot", F.expr(f"{at} - ((shard * {max(total, 1)}L + {shards - 1}) div {shards})"))
    drop(bounds)
    drop_path(docs.sparkSession, first)
    return out.select(*cols, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, source: str = "source", seed: int = 17) -> None:
    """Write docs as Parquet under path, a folder shard=k for each shard, its rows in order of slot."""
    out = interleave(docs, shards, source, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), "source")
    return interleave(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
