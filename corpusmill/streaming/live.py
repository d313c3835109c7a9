"""Streaming counterparts: live latest metrics, live alerts, incremental exact deduplication.

Each gives on a finished stream what its batch operator gives on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.readers import METRIC_ROW


def metric_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New files of the metric table, a bounded number a batch."""
    return spark.readStream.schema(METRIC_ROW).option("maxFilesPerTrigger", files).parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each stage and name by id; for output mode complete or update."""
    return rows.groupBy("stage", "name").agg(F.max_by(F.struct("value", "step", "created_at", "unit"), "id").alias("m")).select("stage", "name", "m.*")


def stops(series: DataFrame, run: str = "config_hash", most: float = 0.05, patience: int = 1) -> DataFrame:
    """(run, step, value, delta, counter, stop) for each observation in order of arrival.

    State of a run: its first value and the counter of rises above ``most``; rows of a batch are
    taken in order of step.  The state is bounded, two numbers a run.
    """

    def observe(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, counter = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, value in zip(rows["step"], rows["value"]):
            first = value if first is None else first
            delta = value - first
            counter = counter + 1 if delta > most else 0
            out.append((key[0], int(step), float(value), float(delta), counter, counter >= patience))
        state.update((float(first), int(counter)))
        yield pd.DataFrame(out, columns=["run", "step", "value", "delta", "counter", "stop"])

    return series.select(F.col(run).alias("run"), "step", "value").groupBy("run").applyInPandasWithState(
        observe, "run string, step long, value double, delta double, counter long, stop boolean", "first double, counter long", "append", "NoTimeout"
    )


def first_copies(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """The first of the documents with one normalized text, within the watermark."""
    return docs.withColumn("norm_hash", T.content_hash(T.dedup_key("text"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["norm_hash"])


def append_batches(rows: DataFrame, path: str, checkpoint: str):
    """The stream appended to a table, one commit a batch; empty batches write nothing."""

    def save(df: DataFrame, _batch: int) -> None:
        if not df.isEmpty():
            df.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
