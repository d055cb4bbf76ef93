"""The same plans over streams, and what only a stream needs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.sanitise import Settings, audited, sanitised
from ..sources.files import ALLOWED, MAX_BYTES, suffix_of


def documents(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files as they come in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, clean: str = "delete") -> DataFrame:
    """A stream of raw files as they come in; each is deleted (or archived, or left: clean) once it is done."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("cleanSource", clean).load(path)
    suffix = suffix_of(F.col("path"))
    return rows.where(F.col("length") <= max_bytes).where((suffix == "") | suffix.isin(*ALLOWED)).withColumn("suffix", suffix)


def cleaned(docs: DataFrame, settings: Settings) -> DataFrame:
    """sanitised() without values; it keeps no state, so it streams as it is."""
    return audited(sanitised(docs, settings))


def first_uploads(docs: DataFrame, time: str = "ts", text: str = "text", late: str = "1 hour") -> DataFrame:
    """docs without those whose text came in before, within the watermark; state is a hash for each text."""
    return docs.withColumn("content_hash", F.sha2(F.col(text), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def counts(events: DataFrame, time: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows in tumbling windows by a column; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def jobs(updates: DataFrame, id: str = "job_id", minutes: int = 60) -> DataFrame:
    """The state of each job, updated as trace rows (job_id, stage, status) come in, and forgotten after minutes without one.

    Waiting jobs make Spark try empty batches: a run that shall end with its input
    (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled set to false.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({id: [key[0]], "steps": [0], "status": ["expired"]})
            return
        n, status = state.get if state.exists else (0, "pending")
        for b in batches:
            n += len(b)
            if (b["status"] == "failed").any():
                status = "error"
            elif status != "error":
                status = "done" if (b["stage"] == "mask").any() else "processing" if status != "done" else status
        state.update((n, status))
        state.setTimeoutDuration(minutes * 60_000)
        yield pd.DataFrame({id: [key[0]], "steps": [n], "status": [status]})

    return updates.groupBy(id).applyInPandasWithState(step, f"{id} string, steps long, status string", "steps long, status string", "update", "ProcessingTimeTimeout")
