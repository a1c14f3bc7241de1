"""Incremental ingest with bounded duplicate memory, windowed counts, and a solved-task tracker with hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest(events: DataFrame, memory: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", memory).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in each window, final once the watermark passes it."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def solved(rows: DataFrame, window: int = 500, on: float = 0.99, off: float = 0.97) -> DataFrame:
    """(task, solved, accuracy) updates from rows (task, correct): accuracy over the last `window` rows; solved from `on` up,
    unsolved again below `off`.  State is one window a task."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ([], False)
        held = list(held)
        for part in parts:
            for c in part["correct"]:
                held = [*held[-window + 1 :], int(c)]
                accuracy = sum(held) / len(held)
                if len(held) == window:
                    done = accuracy >= on or done and accuracy >= off
        state.update((held, done))
        yield pd.DataFrame({"task": [key[0]], "solved": [done], "accuracy": [sum(held) / max(1, len(held))]})

    return rows.groupBy("task").applyInPandasWithState(step, "task string, solved boolean, accuracy double", "held array<int>, done boolean", "update", GroupStateTimeout.NoTimeout)
