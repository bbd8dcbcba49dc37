"""The session machine over a stream, and metrics over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ragloom.operators.sessions import EVENTS, Limits, State, fold

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """State of a connection in a value, until the connection's disconnect; expiry by the clock would keep a triggered run from ending."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("value", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = State.load(self.state.get()[0]) if self.state.exists() else State()
        batch = pd.concat(list(rows))
        yield fold(batch, state, self.limits)
        if state == State():  # after a disconnect nothing is held
            self.state.clear()
        else:
            self.state.update((state.dump(),))

    def close(self) -> None:
        pass


def machine(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Server events of a stream of messages; set spark.sql.streaming.stateStore.providerClass to ``STORE``."""
    named = messages.select(F.col("connection").cast("string").alias("connection"), "seq", "kind", "bytes", "payload")
    return named.groupBy("connection").transformWithStateInPandas(Machine(limits), outputStructType=T._parse_datatype_string(EVENTS), outputMode="Append", timeMode="None")


def joined(frames: DataFrame, starts: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: frames (connection, ts, ...) with the starts (connection, started, ...) before them."""
    f = frames.withWatermark("ts", within).alias("f")
    s = starts.withWatermark("started", within).alias("s")
    return f.join(s, F.expr(f"f.connection = s.connection AND f.ts >= s.started AND f.ts <= s.started + INTERVAL {within}"))


def per_window(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window; works on batches and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def per_session(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than gap apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def once(messages: DataFrame, sink_batch, checkpoint: str):
    """Run what is available through the machine; sink_batch(df, batch_id) gets finalised events. The source bounds a batch
    (maxFilesPerTrigger, maxOffsetsPerTrigger)."""
    return machine(messages).writeStream.foreachBatch(sink_batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
