"""Near-duplicate components by MinHash signatures and a multi-index Hamming join.

A document's signature has K symbols of 16 bits.  The symbols are split into
chunks; if two signatures differ in fewer symbols than ERRORS + 1 for each chunk,
some chunk has at most ERRORS differing symbols (pigeonhole), so the two share the
key of that chunk with those symbols left out.  Every signature is therefore filed
under all its chunks with every choice of ERRORS symbols removed, which guarantees
all pairs under the signature-distance threshold.  Pairs are then confirmed on the
full shingle sets.

The number of chunks follows from the resemblance asked for: a symbol of two sets
of resemblance r differs with probability 1 - r, and a pair right at r is over the
threshold with a probability of MISSED at most (at 0.85: more than 23 of 64
symbols, 2e-5; the same pair at 0.9: under 1e-8).

Large groups of copies never become all their pairs.  Equal sets are one class
from the start.  Neighbours in the sorted index connect most of what is near; under
a key that still holds several components, only what lies outside its largest one
is compared, with the others and with that one, in blocks.  The components of near
signatures are confirmed on the full sets in the same way: their members are dealt
to parts, in which all pairs are compared, twice over; where that leaves a component
unconnected, what lies outside its largest connected part is compared with all the
others, in blocks.  A block hands on no pairs but which class is connected with
which.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks
from ._blocks import in_blocks, in_parts, shared_keys, spanning
from ._store import drop, park, small, unused
from ._text import chunks, mix, shingles, stream, trim
from .components import components

K, ERRORS = 64, 1
MISSED = 3e-5
#: Links of a partition that are reduced to a spanning forest at once.
LINKS = 1 << 20


@dataclass(frozen=True)
class Plan:
    """The symbols of each index key, and the largest distance whose pairs are all found."""

    subsets: list[np.ndarray]
    max_diff: int

    @classmethod
    def of(cls, percent: int) -> Plan:
        differ = 1 - percent / 100
        for parts in range(1, K // (ERRORS + 1) + 1):
            most = parts * (ERRORS + 1) - 1
            over = sum(math.comb(K, d) * differ**d * (1 - differ) ** (K - d) for d in range(most + 1, K + 1))
            if over <= MISSED:
                break
        bounds = np.linspace(0, K, parts + 1).round().astype(int)
        return cls([np.array(s) for a, b in zip(bounds, bounds[1:]) for s in combinations(range(a, b), b - a - ERRORS)], most)


def signatures(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """K 16-bit MinHash symbols of each row's set; zeros for an empty set."""
    out = np.zeros((len(offs) - 1, K), np.uint16)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        a, c = stream(K, 3) | np.uint64(1), stream(K, 5)
        for j in range(K):
            t = hashes ^ c[j]
            t *= a[j]
            t ^= t >> np.uint64(32)
            t *= a[j]
            low = np.minimum.reduceat(t, offs[full])
            out[full, j] = mix(low) >> np.uint64(48)
    return out


def sketch(docs: DataFrame, id: str = "id", text: str = "text", width: int = 5) -> DataFrame:
    """(id, t, n, s1, s2, sig): hash of the text, size of its shingle set, a 128-bit hash of that, and its signature."""

    def run(batches):
        for b in batches:
            ids, t = b["id"], b["t"]
            for lo, hi, buf, offs in chunks(b["text"]):
                h, so = shingles(buf, offs, width)
                sig = signatures(h, so)
                s1, s2 = (_sums(mix(h ^ np.uint64(k)), so).view(np.int64) for k in (17, 29))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), t.slice(lo, hi - lo), pa.array(np.diff(so)), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "t", "n", "s1", "s2", "sig"])
            trim()

    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, t long, n long, s1 long, s2 long, sig binary")


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums, modulo 2^64, of each row's values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def index_keys(classes: DataFrame, plan: Plan) -> DataFrame:
    """(key, id) for each key of each class."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = _sigs(part["sig"]).astype(np.uint64) + np.uint64(1)
                keys = np.empty((len(sig), len(plan.subsets)), np.uint64)
                for j, s in enumerate(plan.subsets):
                    h = np.full(len(sig), j + 1, np.uint64)
                    for i in s:
                        h = mix(h ^ sig[:, i])
                    keys[:, j] = h
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part["id"].to_numpy(), len(plan.subsets)))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links that connect what a and b connect: each id with the smallest it reaches."""
    ids = np.unique(np.concatenate([a, b]))
    root = spanning(ids, np.searchsorted(ids, a), np.searchsorted(ids, b))
    own = np.flatnonzero(root != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(root[own])], ["a", "b"])


def neighbours(entries: DataFrame, plan: Plan) -> DataFrame:
    """Of index entries sorted by key and signature, links (a, b) that connect those next to each other under one key and under the threshold."""

    def run(batches):
        tail, x, y, held = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if tail is not None:
                b = pa.concat_batches([tail, b])
            key, ids, sig = b["key"].to_numpy(), b["id"].to_numpy(), _sigs(b["sig"])
            same = np.flatnonzero((key[1:] == key[:-1]) & (ids[1:] != ids[:-1]))
            ok = same[_differ(sig[same], sig[same + 1]) <= plan.max_diff]
            tail = b.slice(b.num_rows - 1)
            x.append(ids[ok])
            y.append(ids[ok + 1])
            held += len(ok)
            if held >= LINKS:
                yield _forest(np.concatenate(x), np.concatenate(y))
                x, y, held = [], [], 0
        if held:
            yield _forest(np.concatenate(x), np.concatenate(y))

    return entries.repartitionByRange("key", "sig").sortWithinPartitions("key", "sig", "id").mapInArrow(run, "a long, b long")


def outside(groups: DataFrame, n: str = "n") -> DataFrame:
    """(key, rest, big, top) of each key with several parts, from rows (key, part, n): the part that holds most, its entries, and the entries outside it."""
    big = F.max(F.struct(F.col(n).alias("n"), F.col("part").alias("part"))).alias("big")
    per = groups.groupBy("key").agg(F.sum(n).alias("n"), big).select("key", (F.col("n") - F.col("big.n")).alias("rest"), F.col("big.n").alias("big"), F.col("big.part").alias("top"))
    return per.where("rest > 0")


def near_signatures(entries: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that connect what is under the threshold and of different parts, under each key of sizes.

    entries: (key, id, part, sig); sizes: as outside() gives them.
    """

    def compare(t: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        ids, part, sig = t["id"].to_numpy(), t["part"].to_numpy(), _sigs(t["sig"])
        x, y = [], []
        for i in left:
            r = right[part[right] != part[i]]
            r = r[_differ(sig[r], sig[i]) <= plan.max_diff]
            x.append(np.full(len(r), i))
            y.append(r)
        x, y = np.concatenate(x), np.concatenate(y)
        return _forest(ids[x], ids[y]) if len(x) else None

    return in_blocks(entries, sizes, compare, "a long, b long", F.col("part") == F.col("top"))


def overlaps(hashes: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets of rows left and right; hashes are distinct within a row."""
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    col = (np.cumsum(count > 1) - 1)[inverse[shared]]
    row = row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    rows = int(max(left.max(), right.max())) + 1
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (at, at + width))
        m = np.zeros((rows, min(width, int(col[-1]) + 1 - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def _confirming(percent: int, width: int):
    """compare(): links that connect those of its rows whose full shingle sets resemble each other by percent or more."""

    def compare(t: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
        ids, part = t["id"].to_numpy(), t["part"].to_numpy()
        sets = [shingles(buf, offs, width) for _, _, buf, offs in chunks(t["text"].combine_chunks())]
        size = np.concatenate([np.diff(offs) for _, offs in sets])
        both = overlaps(np.concatenate([h for h, _ in sets]), np.repeat(np.arange(len(size)), size), left, right)
        either = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero((both > 0) & (100 * both >= percent * either) & (part[left][:, None] != part[right][None, :]))
        return _forest(ids[left[x]], ids[right[y]]) if len(x) else None

    return compare


def _confirmed(texts: DataFrame, near: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, component) over links on full sets between the members of each component of near (id, component).

    texts: (id, text) of every member.
    """
    compare, links = _confirming(percent, width), "a long, b long"
    member = near.select("id", F.col("component").alias("key"))
    sizes = park(member.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    found = park(in_parts(texts.join(small(member), "id").select("key", "id", F.col("id").alias("part"), "text"), sizes, compare, links), "confirmed")
    sure = components(found)
    # what is under one part has been compared with all of it
    large = member.join(small(sizes.where(F.col("n") > _blocks.BLOCK).select("key")), "key", "left_semi")
    large = park(large.join(small(sure.withColumnRenamed("component", "part")), "id", "left").select("key", "id", F.coalesce("part", "id").alias("part")), "large")
    left = park(outside(large.groupBy("key", "part").agg(F.count("*").alias("n"))), "outside")
    if left.count():
        more = in_blocks(texts.join(small(large.join(small(left.select("key")), "key", "left_semi")), "id").select("key", "id", "part", "text"), left, compare, links, F.col("part") == F.col("top"))
        drop_after, sure = sure, components(found.unionAll(more))
        drop(drop_after)
    for t in (sizes, found, large, left):
        drop(t)
    return sure


@dataclass
class Groups:
    """What is known of rows (id, text): written tables.

    rows: (id, t, n, class) of each row; class is the number of its shingle set,
    null for an empty one and for a null id.  repeated: (id, lo, hi) of the ids of
    several rows, with the smallest and largest class of them.  classes: (id, doc,
    t, ...), doc and t being the smallest id, and its text's hash, in the class.
    linked: (id, component) of the classes that are linked with others.
    """

    rows: DataFrame
    repeated: DataFrame
    classes: DataFrame
    linked: DataFrame

    def drop(self) -> None:
        for t in (self.repeated, self.classes, self.linked):
            drop(t)


def _groups(base: DataFrame, percent: int, width: int) -> Groups:
    plan = Plan.of(percent)
    sketched = park(sketch(base, width=width), "sketches")
    set_of = ["n", "s1", "s2"]
    sets = sketched.where("n > 0 AND id IS NOT NULL").groupBy(*set_of).agg(F.min(F.struct("id", "t")).alias("first"), F.min("sig").alias("sig"))
    classes = park(sets.select(F.monotonically_increasing_id().alias("id"), *set_of, F.col("first.id").alias("doc"), F.col("first.t").alias("t"), "sig"), "classes")
    known = F.col("id").isNotNull()
    rows = sketched.where(known).join(classes.select(F.col("id").alias("class"), *set_of), set_of, "left").select("id", "t", "n", "class")
    rows = park(rows.unionAll(sketched.where(~known).select("id", "t", "n", F.lit(None).cast("long").alias("class"))), "rows")
    repeated = park(rows.where(known).groupBy("id").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("n > 1").select("id", "lo", "hi"), "repeated")
    drop(sketched)

    entries = park(shared_keys(index_keys(classes, plan)).join(classes.select("id", "sig"), "id").select("key", "id", "sig"), "entries")

    # what is near in the sorted index, then what isn't connected so far
    chain = park(neighbours(entries, plan), "chain")
    comp = components(chain)
    parts = park(entries.select("key", "id").join(small(comp.withColumnRenamed("component", "part")), "id", "left").select("key", "id", F.coalesce("part", "id").alias("part")), "parts")
    drop(entries)
    several = park(parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key"), "several")
    open_keys = park(parts.join(small(several), "key", "left_semi"), "open")
    sizes = park(outside(open_keys.groupBy("key", "part").agg(F.count("*").alias("n"))), "outside")
    rest = near_signatures(open_keys.join(classes.select("id", "sig"), "id"), sizes, plan)
    near = components(chain.unionAll(rest))

    # whole texts of the classes that are near others, one each
    member = park(classes.join(small(near.select("id")), "id", "left_semi").select(F.col("id").alias("class"), "doc", F.col("t").alias("hash")), "members")
    texts = base.withColumn("t", F.xxhash64("text")).join(small(member), (F.col("id") == F.col("doc")) & (F.col("t") == F.col("hash"))).select(F.col("class").alias("id"), "text")
    texts = texts.dropDuplicates(["id"]) if repeated.count() else texts
    linked = _confirmed(texts, near, percent, width)
    for t in (chain, comp, parts, several, open_keys, sizes, near, member):
        drop(t)
    return Groups(rows, repeated, classes, linked)


def _base(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their
    distinct word shingles; component_id is the smallest id reachable over links.
    All pairs within the signature distance of the plan are found; a linked pair is
    beyond it with a probability of MISSED at most.  A null, empty or blank text
    has an empty set and is linked with nothing.  Rows of one id count as one
    document, linked by any of their texts, and have one component_id; n_shingles
    is the row's own.  A row with a null id is compared with nothing and comes back
    with a null component and kept.  An empty table gives no rows.  Extra columns
    are not looked at.
    """
    g = _groups(_base(docs, id, text), percent, width)
    total = g.linked
    again = g.rows.join(small(g.repeated), "id").where("class <> lo").select(F.col("class").alias("a"), F.col("lo").alias("b"))
    if g.repeated.where("lo <> hi").count():
        total = components(total.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(again))
    of = g.classes.join(small(total), "id").groupBy("component").agg(F.min("doc").alias("least"))
    least = park(total.join(of, "component").select(F.col("id").alias("class"), "least"), "least")
    label = park(g.classes.select(F.col("id").alias("class"), "doc").join(small(least), "class", "left").select("class", F.coalesce("least", "doc").alias("label")), "labels")
    rows = g.rows
    if g.repeated.count():
        rows = rows.join(small(park(g.repeated.select("id", "lo"), "repeated")), "id", "left").withColumn("class", F.coalesce("class", "lo"))
    out = rows.join(small(label), "class", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
    drop(least)
    if total is not g.linked:
        drop(total)
    g.drop()
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: of the smallest id, then the smallest hash of its text.

    Rows are compared by their texts alone, whatever ids they share, so no text
    goes without one near it that stays; of rows equal in id and text any one
    stays.  Rows with a null id, and null, empty and blank texts, all stay.  All
    columns of docs stay as they are.
    """
    g = _groups(_base(docs, id, text), percent, width)
    group = g.classes.join(small(g.linked), "id", "left").select("id", "doc", "t", F.coalesce("component", "id").alias("component"))
    first = group.groupBy("component").agg(F.min(F.struct("doc", "t")).alias("first"))
    first = park(group.join(first, "component").select(F.col("id").alias("class"), F.col("first.doc").alias("doc"), F.col("first.t").alias("hash")), "first")
    rows = g.rows.where("class IS NOT NULL")
    own, hash = unused(docs, "id"), unused(docs, "hash")
    pair = [F.col("id").alias(own), F.col("t").alias(hash)]
    gone = park(rows.join(small(first), "class").where("id <> doc OR t <> hash").select(*pair).distinct(), "gone")
    twice = park(rows.join(small(g.repeated.select("id")), "id", "left_semi").groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").select(*pair), "twice")
    keyed = docs.withColumns({own: F.col(f"`{id}`").cast("long"), hash: F.xxhash64(F.col(f"`{text}`").cast("string"))})
    kept = keyed.join(small(gone), [own, hash], "left_anti")
    if twice.count():
        kept = kept.join(small(twice), [own, hash], "left_anti").select(*keyed.columns).unionAll(kept.join(small(twice), [own, hash], "left_semi").select(*keyed.columns).dropDuplicates([own, hash]))
    drop(first)
    g.drop()
    return kept.select(*[f"`{c}`" for c in docs.columns])


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
