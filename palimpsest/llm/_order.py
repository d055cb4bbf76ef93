"""Global positions of rows in a sort order, without a window over all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._store import park_path, small, unused


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> tuple[DataFrame, str]:
    """df with the position of each row, from 0, in the given order; and the path of the table it is read from.

    Rows are dealt by ranges of the order, so a hot key spreads over tasks, and are
    written sorted; a row's position is its place in its file plus the rows of the
    files before, of which only one count a file passes the driver.
    """
    path = park_path(df.repartitionByRange(*order).sortWithinPartitions(*order), "sorted")
    return positions(df.sparkSession, path, df.schema, name), path


def positions(spark: SparkSession, path: str, schema: StructType, name: str = "pos") -> DataFrame:
    """A table that Spark wrote, with the position of each row in it: parts in turn, a part's files in turn, rows as they stand."""
    kept = spark.read.schema(schema).parquet(path)
    file, row, start = (unused(kept, n) for n in ("file", "row", "start"))
    rows = kept.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    files = [(r[0], r[1]) for r in rows.groupBy(file).count().collect()]  # a row for each file
    starts, total = [], 0
    for f, n in sorted(files, key=lambda f: _turn(f[0])):
        starts.append((f, total))
        total += n
    offsets = small(spark.createDataFrame(starts, f"{file} string, {start} long"), len(starts))
    out = rows.join(offsets, file).withColumn(name, F.col(start) + F.col(row)).drop(file, row, start)
    out._rows = total
    return out


def _turn(file: str) -> tuple[int, int]:
    """Place of a file among those of its table: its part and, a part having several where spark.sql.files.maxRecordsPerFile is set, its number in it."""
    part, number = re.fullmatch(r"part-(\d+)-.*-c(\d+)\D.*", file).groups()
    return int(part), int(number)
