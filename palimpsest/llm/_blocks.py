"""Pairs of the entries under one key, compared in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import small

#: Entries of a block, about; two blocks meet in one place.
BLOCK = 128

Compare = Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None]


def shared_keys(index: DataFrame) -> DataFrame:
    """The rows of index (key, id, ...) whose key stands in several rows, and some few others.

    The rows are sorted by ranges of (key, id), so a hot key spreads over tasks;
    the first and the last key of a task may go on in the next one and stay.
    """

    def run(batches):
        held, as_before = None, True
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.concat_batches([held, b])
            key = b["key"].to_numpy()
            same = key[1:] == key[:-1]
            before = np.concatenate(([as_before], same))
            yield b.slice(0, len(key) - 1).filter(pa.array(before[:-1] | same))
            held, as_before = b.slice(len(key) - 1), bool(before[-1])
        if held is not None:
            yield held

    return index.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, index.schema)


def in_blocks(entries: DataFrame, sizes: DataFrame, compare: Compare, schema: str, main: Column | None = None, block: int | None = None) -> DataFrame:
    """What compare(table, left, right) makes of each two blocks of each key.

    entries: (key, id, ...); sizes: (key, rest, big, ...); keys missing there are
    left out.  main, a condition on the columns of both, tells the big entries of a
    key, which needn't be compared with each other, from the rest (default: all
    are the rest).  Both are dealt to blocks of about block entries by id.  Every two blocks of the rest,
    a block and itself included, and every block of the rest with every big block
    are one group of their own, so no key meets in one task and a big entry is
    copied once for each block of the rest.  left and right are row numbers of
    table; they are equal when a block meets itself.
    """
    own = [c for c in entries.columns if c != "key"]
    both = entries.join(small(sizes), "key").withColumns({"main": F.lit(False) if main is None else main, "r": F.ceil(F.col("rest") / (block or BLOCK)).cast("int"), "b": F.ceil(F.col("big") / (block or BLOCK)).cast("int")})
    at = F.xxhash64("id")
    both = both.withColumn("p", F.when(F.col("main"), F.col("r") + F.pmod(at, F.greatest("b", F.lit(1)))).otherwise(F.pmod(at, F.greatest("r", F.lit(1)))).cast("int"))
    partners = F.sequence(F.lit(0), F.when(F.col("main"), F.col("r")).otherwise(F.col("r") + F.col("b")) - 1)
    dealt = both.where("r > 0").select("key", *own, "p", F.explode(partners).alias("q"))
    return grouped(dealt.select("key", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "p", *own), compare, schema)


def in_parts(entries: DataFrame, sizes: DataFrame, compare: Compare, schema: str, deals: int = 2) -> DataFrame:
    """What compare makes of each part of each key, its entries being dealt to parts of about BLOCK, deals times over.

    entries: (key, id, ...); sizes: (key, n).  A key of up to BLOCK entries is one
    part, dealt once.
    """
    own = [c for c in entries.columns if c != "key"]
    both = entries.join(small(sizes.select("key", "n")), "key").withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = both.select("key", "g", *own, F.explode(F.sequence(F.lit(0), F.when(F.col("g") > 1, deals).otherwise(1) - 1)).alias("deal"))
    part = F.pmod(F.xxhash64("id", "deal"), F.col("g")).cast("int") + F.col("deal") * F.col("g")
    return grouped(dealt.select("key", part.alias("u"), part.alias("v"), part.alias("p"), *own), compare, schema)


def grouped(dealt: DataFrame, compare: Compare, schema: str) -> DataFrame:
    """compare, applied to each (key, u, v) with the rows of blocks p = u and p = v."""

    def whole(t: pa.Table) -> pa.RecordBatch | None:
        p = t["p"].to_numpy()
        left, right = np.flatnonzero(p == t["u"][0].as_py()), np.flatnonzero(p == t["v"][0].as_py())
        return compare(t.combine_chunks(), left, right) if len(left) and len(right) else None

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            cuts = np.flatnonzero(np.any([(h := t[c].to_numpy())[1:] != h[:-1] for c in ("key", "u", "v")], axis=0)) + 1
            at = 0
            for e in cuts.tolist():
                if e - at > 1 and (out := whole(t.slice(at, e - at))) is not None:
                    yield out
                at = e
            held = t.slice(at)
        if held is not None and held.num_rows > 1 and (out := whole(held)) is not None:
            yield out

    return dealt.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(run, schema)


def spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For links between rows i and j, the smallest id that each row reaches (its own if none)."""
    names, node = np.unique(ids, return_inverse=True)
    a, b = node[i], node[j]
    root = np.arange(len(names))
    while True:
        # hook the larger root of each link under the smaller, then let all jump to their roots
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return names[root[node]]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
