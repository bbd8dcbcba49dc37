"""Voice sessions in batch form: frames and control events of a connection, in order, to server events.

A row is (connection, seq, kind, bytes, payload): kind 'binary' with a number
of bytes, 'text' with a JSON payload, or 'disconnect'. ``machine`` is the
stateful fold that the streaming form uses too; ``segments`` and ``buffered``
are the same by window functions, partitioned by connection.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.functions.fixed import DEFAULT_LOCALE, ERRORS, LOCALES, MAX_AUDIO_MB, SERVER_EVENTS, STAGES

EVENTS = "connection string, seq long, ordinal int, type string, request_id string, detail string"
RUN_STAGES = [s for s in STAGES if s != "grounding"]


@dataclass
class State:
    """active is receiving audio; request_id outlives the session, as later errors name it."""

    active: bool = False
    request_id: str = ""
    language: str | None = None
    session_id: str | None = None
    size: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> State:
        return State(**json.loads(text))


@dataclass(frozen=True)
class Limits:
    """A frame over ``frame`` bytes is refused; audio over ``audio`` bytes, or ``ms`` (32 bytes each), fails at its end."""

    audio: int = int(MAX_AUDIO_MB * 1024 * 1024)
    frame: int | None = None
    ms: int | None = None


def step(s: State, kind: str, size: int, payload: str | None, limits: Limits = Limits(), fresh: str = "generated") -> list[tuple[str, str, str]]:  # noqa: B008
    """Changes s by one message; the server events (type, request_id, detail). fresh: the id of a start that has none.
    A disconnect ends the session without an event; a connection that returns begins anew."""
    if kind == "disconnect":
        s.__init__()
        return []
    if kind == "binary":
        if size <= 0:
            return []
        if not s.active:
            return [("error", s.request_id or "unknown", "INVALID_REQUEST")]
        if limits.frame is not None and size > limits.frame:
            return [("error", s.request_id, "INVALID_REQUEST")]
        s.size += size
        return []
    if not payload:
        return []
    try:
        event = json.loads(payload)
    except ValueError:
        event = None
    if not isinstance(event, dict):
        return [("error", s.request_id or "unknown", "INVALID_REQUEST")]
    name, given = event.get("type"), event.get("request_id")
    if name == "session_start":
        s.request_id, s.language, s.session_id, s.size, s.active = given if given is not None else fresh, event.get("language"), event.get("session_id"), 0, True
        if s.language and s.language not in LOCALES:
            s.active = False
            return [("error", s.request_id, "UNSUPPORTED_LANGUAGE"), ("complete", s.request_id, "failed")]
        return []
    if name == "cancel":
        s.active = False
        return [("complete", given if given is not None else s.request_id, "cancelled")]
    if name == "audio_end" and s.active:
        s.active = False
        out = [("warning", s.request_id, "REQUEST_ID_MISMATCH")] if given is not None and given != s.request_id else []
        if not 0 < s.size <= limits.audio or (limits.ms is not None and s.size // 32 > limits.ms):
            return [*out, ("error", s.request_id, "INVALID_REQUEST"), ("complete", s.request_id, "failed")]
        return [*out, ("transcript", s.request_id, s.language or "auto"), *(("processing", s.request_id, x) for x in RUN_STAGES), ("answer", s.request_id, str(s.size)), ("complete", s.request_id, "success")]
    return []


def fold(rows: pd.DataFrame, state: State, limits: Limits = Limits()) -> pd.DataFrame:  # noqa: B008
    """Messages of one connection, in order of seq. A start without request_id gets one from its connection and seq."""
    out = []
    for r in rows.sort_values("seq").itertuples():
        size = 0 if pd.isna(r.bytes) else int(r.bytes)
        fresh = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{r.connection}|{r.seq}"))
        for i, (kind, request, detail) in enumerate(step(state, r.kind, size, None if pd.isna(r.payload) else r.payload, limits, fresh)):
            out.append((r.connection, r.seq, i, kind, request, detail))
    return pd.DataFrame(out, columns=["connection", "seq", "ordinal", "type", "request_id", "detail"])


def machine(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Server events of all connections. Rows are sorted within partitions and folded one by one, so the length of a
    connection does not matter to memory."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = State(), None
        for b in batches:
            parts = []
            for connection, rows in b.groupby("connection", sort=False):
                if connection != held:
                    state, held = State(), connection
                parts.append(fold(rows, state, limits))
            if parts:
                yield pd.concat(parts)

    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = messages.where(F.col("connection").isNotNull()).select(F.col("connection").cast("string").alias("connection"), "seq", "kind", "bytes", "payload")
    return named.repartition(n, "connection").sortWithinPartitions("connection", "seq").mapInPandas(run, EVENTS)


def wire(events: DataFrame, timestamp: Column) -> DataFrame:
    """json: each event as the contract has it. An error has a message and whether it may be retried; a transcript its
    text (empty: of audio only the number of bytes is here), language and is_final; an answer the answer, not grounded, without sources."""
    kind, detail = F.col("type"), F.col("detail")
    of = lambda t, v: F.when(kind == t, v)
    retry = detail.isin([c for c, (_, again) in ERRORS.items() if again])
    data = F.struct(
        of("processing", detail).alias("stage"), of("error", detail).alias("code"), of("error", F.lower(F.translate(detail, "_", " "))).alias("message"), of("error", retry).alias("retryable"),
        of("complete", detail).alias("status"), of("transcript", F.lit("")).alias("text"), of("transcript", F.when(detail.isin(LOCALES), detail).otherwise(DEFAULT_LOCALE)).alias("language"), of("transcript", F.lit(True)).alias("is_final"),
        of("answer", F.concat(detail, F.lit(" bytes of audio"))).alias("answer"), of("answer", F.lit(False)).alias("grounded"), of("answer", F.array().cast("array<string>")).alias("sources"),
    )
    return events.where(kind.isin(SERVER_EVENTS)).select("*", timestamp.alias("timestamp"), F.to_json(data).alias("data")).withColumn(
        "json", F.concat(F.regexp_replace(F.to_json(F.struct("type", "request_id", "timestamp")), r"\}$", ',"data":'), F.col("data"), F.lit("}"))
    )


def segments(messages: DataFrame) -> DataFrame:
    """messages with session: how many starts the connection has had so far."""
    so_far = W.partitionBy("connection").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.coalesce((F.col("kind") == "text") & (F.get_json_object("payload", "$.type") == "session_start"), F.lit(False))
    return messages.withColumn("session", F.sum(start.cast("int")).over(so_far))


def buffered(messages: DataFrame) -> DataFrame:
    """Bytes and frames per connection and session: the buffer a start resets."""
    return segments(messages).where("session > 0").groupBy("connection", "session").agg(F.sum(F.when(F.col("kind") == "binary", F.col("bytes")).otherwise(0)).cast("long").alias("bytes"), F.count(F.when(F.col("kind") == "binary", 1)).alias("frames"))
