"""Structured Streaming: resumable ingestion of records, running endpoints, event-time windows and last states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.operators.endpoints import endpoint_columns
from tandemlab.operators.observations import COLUMNS


def record_stream(spark: SparkSession, folder: str, schema: object, key: str, event_time: str, late: str = "7 days", files_per_trigger: int = 1) -> DataFrame:
    """Records of a growing folder, each key once within ``late`` of its first delivery: a restarted query goes on where its checkpoint ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def running_endpoints(stream: DataFrame, tau: float) -> DataFrame:
    """Endpoints per run and condition, to be written in update or complete mode."""
    rows = stream.selectExpr(*[f"{e} as {n}" for n, e in COLUMNS.items()]).filter("y is not null")
    return rows.groupBy("run_id", "cond").agg(*endpoint_columns(tau))


def event_windows(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and value sums of events per type and window; windows close ``late`` after their end."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Events per user and session; a session ends after a gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def last_states(stream: DataFrame) -> DataFrame:
    """(user_id, events, last_type) after every batch, by a custom stateful operator."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, kind = state.get if state.exists else (0, 0, "")
        for pdf in batches:
            n += len(pdf)
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if row["ts"].value >= at:
                at, kind = int(row["ts"].value), str(row["event_type"])
        state.update((n, at, kind))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_type": [kind]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, events bigint, last_type string", "events bigint, at bigint, last_type string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available into a memory table and returns it (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
