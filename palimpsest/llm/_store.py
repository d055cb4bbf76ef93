"""Tables kept for a while in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows of at most 32 bytes, that is ever broadcast.
BROADCAST_ROWS = 100_000

#: The temporary folder of each local application.
_local: dict[str, str] = {}
#: Tables written and not yet deleted.
_live: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, local runs such as tests get a temporary folder, a cluster
    an error, as no machine's own folder is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def park_path(df: DataFrame, name: str, **options: str) -> str:
    """Write df to the shared folder; its path."""
    path = new_path(df.sparkSession, name)
    _live.append(path)
    df.write.options(**options).parquet(path)
    return path


def park(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    path = park_path(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._parked_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a parked table that no later plan reads."""
    drop_path(df.sparkSession, df._parked_at)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    if path in _live:
        _live.remove(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was parked inside: what an operator returns reads some of its tables, so use it up inside.

    Tables parked outside any scratch() go when the program ends, if Spark still runs.
    """
    before = set(_live)
    try:
        yield
    finally:
        for path in [p for p in _live if p not in before]:
            drop_path(spark, path)


@atexit.register
def _swept() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_live):
            with contextlib.suppress(Exception):  # the cluster may be going down
                drop_path(spark, path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a parked table of a few bytes a row for broadcast if its counted rows stay under the bound."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
