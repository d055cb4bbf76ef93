"""Near-duplicate vectors by random-hyperplane sign hashing and exact cosine.

In each of several tables a vector's bucket is the signs of its products with
random hyperplanes.  Signs of two vectors at a cosine c agree with probability
1 - acos(c) / pi, so the number of tables follows from the bits, the threshold and
the share of links that may be missed.  Vectors that share a bucket are compared
exactly, in double precision; components of the links are found in a distributed
way.

Near copies share many buckets, so buckets are brought together before vectors
move: those with the same smallest member have one home, a vector travels to a home
once, and a home holds at most one bucket of each table.  Larger buckets are
compared in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import in_blocks, shared_keys, spanning
from ._store import drop, park, small
from ._text import Cache, mix, stream
from .components import components

#: Probability with which a pair right at the threshold is missed.
MISSED = 1e-5
#: Vectors of a block; larger buckets are dealt to blocks.
BLOCK = 512
#: Members, counted once for each bucket, after which the next buckets of a home get a place of their own, so none holds much more than two blocks.
HOME = 2 * BLOCK


def plan_tables(n: int, cosine: float, missed: float = MISSED) -> tuple[int, int]:
    """(bits, tables): buckets of unrelated vectors stay mostly single as n grows, and recall stays the same."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 6, 10), 48)
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(missed) / math.log(1 - agree**bits))


_planes: dict[tuple[int, int], np.ndarray] = Cache()


def hyperplanes(dim: int, count: int) -> np.ndarray:
    """The same count random directions for a dimension, everywhere."""
    if (dim, count) not in _planes:
        _planes[dim, count] = np.random.default_rng([1, dim]).standard_normal((dim, count))
    return _planes[dim, count]


def _codes(x: np.ndarray, bits: int, tables: int, first: int | None = None) -> np.ndarray:
    """The bucket of each row in each table, or in the first few."""
    planes = hyperplanes(x.shape[1], bits * tables)
    tables = tables if first is None else first
    weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
    out = np.empty((len(x), tables), np.uint64)
    step = max(1, (1 << 21) // (tables * bits))
    for at in range(0, len(x), step):
        sign = (x[at : at + step] @ planes[:, : tables * bits] > 0).reshape(-1, tables, bits)
        out[at : at + step] = (sign * weight).sum(-1, dtype=np.uint64)
    return out


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _vectors(table: DataFrame, id: str, vector: str, kind: type) -> DataFrame:
    """(id, dim, vec): the components, as they are if they are floats, else as doubles divided by the largest, so that no norm over- or underflows; dim 0 and no vec for vectors that link with nothing."""

    def run(batches):
        for b in batches:
            dim, vec = [], []
            lists = b["v"]
            for at in range(0, b.num_rows, 4096):
                part = lists.slice(at, 4096)
                flat = part.flatten()
                gap = np.concatenate(([0], np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False))))
                x = flat.fill_null(0.0).to_numpy() + kind(0)
                size = np.array([0 if n is None else n for n in part.value_lengths().to_pylist()], np.int64)
                end = np.cumsum(size)
                for a, e in zip((end - size).tolist(), end.tolist()):
                    v = x[a:e]
                    ok = e > a and gap[e] == gap[a] and np.isfinite(v).all() and v.any()
                    if ok and kind is np.float64:
                        v = v / np.abs(v).max()
                    dim.append(e - a if ok else 0)
                    vec.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], ["id", "dim", "vec"])

    of = "array<float>" if kind is np.float32 else "array<double>"
    return table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(of).alias("v")).mapInArrow(run, "id long, dim int, vec binary")


def near_duplicates(table: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, missed: float = MISSED) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of table.

    Two vectors of one dimension are linked if their cosine, in double precision,
    is cosine or more; n_links counts the other rows that a row is linked with,
    copies included, and component_id is the smallest id reachable.  Vectors that
    are null, empty, zero or hold null or non-finite components, and rows with a
    null id, link with nothing and are kept; finite ones count however large or
    small.  Labels and other columns are not looked at; an empty table gives no
    rows.
    """
    kind = np.float32 if table.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    set_of = ["dim", "h1", "h2"]
    rows = park(_vectors(table, id, vector, kind).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")}), "vectors")
    classes = park(rows.where("dim > 0 AND id IS NOT NULL").groupBy(*set_of).agg(F.count("*").alias("copies"), F.min("id").alias("doc"), F.first("vec").alias("vec")).withColumn("id", F.monotonically_increasing_id()), "classes")
    bits, tables = plan_tables(classes.count(), cosine, missed)

    def keys(batches):
        salt = stream(tables, 23)
        for b in batches:
            dims = b["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, 1024):
                    p = part.slice(at, 1024)
                    code = mix(mix(_codes(_matrix(p["vec"], kind), bits, tables) ^ salt) + np.uint64(d))
                    yield pa.RecordBatch.from_arrays([pa.array(code.ravel().view(np.int64)), pa.array(np.repeat(p["id"].to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), p.num_rows))], ["key", "id", "t"])

    index = park(shared_keys(classes.select("id", "dim", "vec").mapInArrow(keys, "key long, id long, t int")), "index")
    # of buckets with the same members one is enough: the first, as that is where their pairs count
    members = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(20,0)")).alias(f"m{k}") for k in (1, 2)]
    buckets = index.groupBy("key").agg(F.count("*").alias("rest"), F.min("t").alias("t"), F.min("id").alias("home"), *members).where("rest > 1")
    first = buckets.groupBy("rest", "m1", "m2").agg(F.min(F.struct("t", "key", "home")).alias("first")).select("first.*", "rest")
    before = F.sum("rest").over(Window.partitionBy("home", F.col("rest") > BLOCK).orderBy("t")) - F.col("rest")
    sizes = park(first.select("key", "rest", F.lit(0).cast("long").alias("big"), "home", F.floor(before / HOME).cast("int").alias("part")), "buckets")
    large = sizes.where(F.col("rest") > BLOCK).select("key", "rest", "big")
    entries = index.join(small(large.select("key")), "key", "left_semi").join(classes.select("id", "copies", "vec"), "id").select("key", "t", "id", "copies", "vec")
    # a row for each vector and home; its tables are bounded, as a home holds one bucket of a table
    housed = index.join(small(sizes.where(F.col("rest") <= BLOCK).select("key", "home", "part")), "key").groupBy("home", "part", "id").agg(F.collect_list("t").alias("ts"))
    housed = housed.join(classes.select("id", "copies", "vec"), "id").select("home", "part", "id", "ts", "copies", "vec")

    def share_first(code: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The first table in which rows i and j share a bucket, for each two."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 14):
            out[at : at + (1 << 14)] = (code[i[at : at + (1 << 14)]] == code[j[at : at + (1 << 14)]]).argmax(1)
        return out

    def at_home(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, norm: np.ndarray, there: np.ndarray) -> pa.RecordBatch | None:
        """The links of a home; there tells in which of its tables a row is."""
        links, every = np.zeros(len(ids), np.int64), np.arange(len(ids))
        up = every[:0], every[:0]
        code = None
        for at in range(0, len(ids), BLOCK):
            cos = (x[at : at + BLOCK] @ x[at:].T) / norm[at : at + BLOCK, None] / norm[None, at:]
            i, j = np.nonzero(cos >= cosine)
            i, j = i[i < j] + at, j[i < j] + at
            ok = np.zeros(len(i), bool)
            if len(i):
                code = _codes(x, bits, tables) if code is None else code
                # a pair counts in the first bucket that it shares, in whichever home that is
                t = share_first(code, i, j)
                ok = there[i, t] & there[j, t]
            i, j = i[ok], j[ok]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = spanning(every, np.concatenate([up[0], i]), np.concatenate([up[1], j]))
                up = np.flatnonzero(root != every), root[root != every]
        own = np.flatnonzero(links)
        if not len(own):
            return None
        root = every.copy()
        root[up[0]] = up[1]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(links[own]), pa.array(ids[root[own]])], ["id", "links", "root"])

    def homes(t: pa.Table):
        """The links of whole homes, one after another; all vectors of a home have one dimension."""
        size = pc.binary_length(t["vec"]).to_numpy()
        for d in np.unique(size).tolist():
            g = t.filter(pa.array(size == d)).combine_chunks()
            ids, copies, x = g["id"].to_numpy(), g["copies"].to_numpy(), _matrix(g["vec"], kind)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            ts = g["ts"].combine_chunks()
            there = np.zeros((len(ids), tables), bool)
            there[np.repeat(np.arange(len(ids)), pc.list_value_length(ts).to_numpy()), ts.flatten().to_numpy()] = True
            ends = [0, *starts_of(g).tolist(), len(ids)]
            for a, e in zip(ends, ends[1:]):
                if e - a > 1 and (out := at_home(ids[a:e], copies[a:e], x[a:e], norm[a:e], there[a:e])) is not None:
                    yield out

    def starts_of(t: pa.Table) -> np.ndarray:
        home, part = t["home"].to_numpy(), t["part"].to_numpy()
        return np.flatnonzero((home[1:] != home[:-1]) | (part[1:] != part[:-1])) + 1

    def in_homes(batches):
        held = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                starts = starts_of(t)
                whole = int(starts[-1]) if len(starts) else 0
                yield from homes(t.slice(0, whole))
                held = t.slice(whole)
        if held is not None:
            yield from homes(held)

    def compare(g: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        ids, copies, t = g["id"].to_numpy(), g["copies"].to_numpy(), g["t"][0].as_py()
        x = _matrix(g["vec"], kind)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cos = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None, :]
        i, j = np.nonzero(cos >= cosine)
        i, j = left[i], right[j]
        ok = ids[i] < ids[j] if np.array_equal(left, right) else ids[i] != ids[j]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        # a pair that shares several buckets counts in the first of them
        own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        same = share_first(_codes(x[own], bits, tables, t + 1), at[: len(i)], at[len(i) :]) == t
        i, j = i[same], j[same]
        if not len(i):
            return None
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = spanning(ids, i, j)
        own = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(links[own]), pa.array(root[own])], ["id", "links", "root"])

    schema = "id long, links long, root long"
    housed = housed.repartition("home", "part").sortWithinPartitions("home", "part").mapInArrow(in_homes, schema)
    found = park(housed.unionAll(in_blocks(entries, large, compare, schema, block=BLOCK)), "links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # a component is called by the smallest id of its rows
    named = classes.select("id", "doc", *set_of, "copies").join(small(comp), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = park(named.join(small(comp.select("component").distinct()), "component", "left_semi").groupBy("component").agg(F.min("doc").alias("least")), "least")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    done = named.join(small(least), "component", "left").join(linked, "id", "left")
    done = park(done.select(*set_of, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "doc").alias("component")), "done")
    out = rows.select("id", *set_of).join(done, set_of, "left")
    alone = F.col("dim").eqNullSafe(0) | F.col("id").isNull()
    out = out.select(F.col("id").alias(id), F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component_id"))
    for p in (classes, index, sizes, found, comp, least):
        drop(p)
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def op10_cosine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
