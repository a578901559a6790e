"""Streaming counterparts: incremental document ingest, event windows and sustained-threshold alarms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New text files as (name, text), whole."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return stream.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def ingest(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `batch` over each micro-batch of documents; the checkpoint makes a restart go on where it stopped, and batch numbers
    let the sink write a batch once."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out in a stream. Works on batches too."""
    if events.isStreaming:  # watermarks are on timestamps with a time zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sustained(points: DataFrame, key: str, order: list[str], hot: str, least: int) -> DataFrame:
    """Runs of at least `least` consecutive points of a key for which the condition holds: (key, run, n, first, last), in batch,
    by gaps and islands."""
    by = Window.partitionBy(key).orderBy(*order)
    numbered = points.withColumn("hot", F.expr(hot)).withColumn("at", F.row_number().over(by))
    island = F.col("at") - F.row_number().over(Window.partitionBy(key, "hot").orderBy(*order))
    runs = numbered.withColumn("island", island).where("hot").groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return runs.where(F.col("n") >= least).select(key, "first", "last", "n")


def sustained_stream(points: DataFrame, key: str, key_type: str, least: int) -> DataFrame:
    """The same alarm on a stream of (key, ts, hot boolean): a row (key, n) each time a run reaches `least` points. The state of a
    key is the length of its current run."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        alarms = []
        for hot in pd.concat(list(batches)).sort_values("ts")["hot"]:
            run = run + 1 if hot else 0
            if run == least:
                alarms.append(run)
        state.update((run,))
        yield pd.DataFrame({key: [k[0]] * len(alarms), "n": alarms})

    return points.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, n long", "run long", "append", "NoTimeout")
