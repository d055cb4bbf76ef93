"""Connected components of a link table, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import spanning
from ._store import drop, park

#: Links, of 16 bytes, that one task may take: a table of up to so many is settled without a shuffle.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every id in the links (a, b) of longs; component is the smallest id reachable.

    A table of up to one_task links is settled by one task.  A larger one goes
    through large-star and small-star steps in turn (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014) until nothing changes: O(log^2 n)
    rounds at worst, a handful in practice.  Neighbour minima are partially
    aggregated and each step's tables are written, so a hub's links split over
    tasks, and a lost executor costs one step at most.  Nulls and loops are
    ignored, an empty table gives an empty one.  The result is a written table.
    """
    a, b = F.col("a"), F.col("b")
    now = park(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "links")
    if now.count() <= one_task:
        out = park(_settled(now), "components")
        drop(now)
        return out
    mark = None
    while True:
        for step in ("large", "small"):
            if step == "large":
                pairs = now.select("a", "b").unionAll(now.select(b.alias("a"), a.alias("b")))
            else:
                pairs = now.select("a", "b")
            low = park(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
            told = pairs.join(low.withColumnRenamed("a", "k"), a == F.col("k"))
            star = told.where(b > a).select(b.alias("a"), F.col("m").alias("b")) if step == "large" else told.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
            star = star.unionAll(low.where("a <> m").select("a", F.col("m").alias("b")))
            last, now = now, park(star.where("a <> b").distinct(), "links")
            drop(low)
            drop(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    # every link is now (id, smallest id)
    out = park(now.select(a.alias("id"), b.alias("component")).unionAll(now.select(b.alias("id"), b.alias("component")).distinct()), "components")
    drop(now)
    return out


def _settled(links: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            ids = np.unique(np.concatenate([a, b]))
            root = spanning(ids, np.searchsorted(ids, a), np.searchsorted(ids, b))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id long, component long")
