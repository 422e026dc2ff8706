"""Streams: windows over events, and workflow state that resumes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema: str, files: int = 8) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "0 seconds", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of fixed windows; works on streams, with a watermark, and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "0 seconds") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


STATE = "workflow_id string, stage1 string, done int, attempts long, seq long"


def workflow_states(events: DataFrame, chunks: int, staged: bool = False) -> DataFrame:
    """The state of each workflow after each batch, from a stream of events (workflow_id, seq, event, chunk_index).

    The state is in Spark's checkpoint, so a query that is started again goes on where it was.  Events that were
    seen before (by seq) change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, done, attempts, seq = state.get if state.exists else ("ready", [], 0, -1)
        done = set(done)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if r.seq <= seq:
                continue
            seq = int(r.seq)
            if r.event == "run" and stage in ("ready", "failed_recoverable", "chunk_running"):
                stage, attempts = "chunk_running", attempts + 1
            elif r.event == "chunk_done" and stage == "chunk_running":
                done.add(int(r.chunk_index))
                stage = "ready_to_merge" if len(done) >= chunks else "awaiting_continue" if staged else "ready"
            elif r.event == "chunk_failed" and stage == "chunk_running":
                stage = "failed_recoverable"
            elif r.event == "approve" and stage == "awaiting_continue":
                stage = "ready"
            elif r.event == "merge_ok" and stage == "ready_to_merge":
                stage = "complete"
        state.update((stage, sorted(done), attempts, seq))
        yield pd.DataFrame([(key[0], stage, len(done), attempts, seq)], columns=["workflow_id", "stage1", "done", "attempts", "seq"])

    return events.groupBy("workflow_id").applyInPandasWithState(step, STATE, "stage1 string, done array<int>, attempts long, seq long", "update", GroupStateTimeout.NoTimeout)
