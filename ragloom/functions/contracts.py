"""Contract checks: each gives the names of the violated rules, joined by commas, in a fixed order ('' if valid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.fixed import CLIENT_EVENTS, COMPLETIONS, ERROR_CODES, LOCALES, MOST_TOP_K, PROVIDERS, SERVER_EVENTS, STAGES


def _violated(rules: list[tuple[str, Column]]) -> Column:
    """rules: name and the condition under which it is violated; null counts as not violated."""
    return F.array_join(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules))), ",")


def _missing(c: Column) -> Column:
    return c.isNull() | (F.length(c) == 0)


def query(request_id: Column, text: Column, language: Column, top_k: Column, session_id: Column) -> Column:
    return _violated([
        ("request_id", _missing(request_id)),
        ("query", _missing(text)),
        ("language", language.isNull() | ~language.isin(LOCALES)),
        ("top_k", (top_k < 1) | (top_k > MOST_TOP_K)),
        ("session_id", F.length(session_id) == 0),
    ])


def transcript(request_id: Column, text: Column, language: Column, is_final: Column, provider: Column, confidence: Column, timestamp_ms: Column, duration_ms: Column) -> Column:
    return _violated([
        ("request_id", _missing(request_id)),
        ("text", text.isNull()),
        ("language", language.isNull() | ~language.isin(LOCALES)),
        ("is_final", is_final.isNull()),
        ("provider", provider.isNull() | ~provider.isin(PROVIDERS)),
        ("confidence", (confidence < 0) | (confidence > 1)),
        ("timestamp_ms", timestamp_ms < 0),
        ("duration_ms", duration_ms < 0),
    ])


def answer(request_id: Column, text: Column, language: Column, grounded: Column, sources: Column, latency: Column) -> Column:
    """sources: array of (id, text, score, ...); latency: struct with total_ms and the stages' milliseconds."""
    stages = ["embedding_ms", "retrieval_ms", "reranking_ms", "generation_ms"]
    stage = F.lit(False)
    for s in stages:
        stage = stage | F.coalesce(latency[s] < 0, F.lit(False))
    return _violated([
        ("request_id", _missing(request_id)),
        ("answer", _missing(text)),
        ("language", language.isNull() | ~language.isin(LOCALES)),
        ("grounded", grounded.isNull()),
        ("sources", sources.isNull()),
        ("source", F.exists(sources, lambda s: s["id"].isNull() | s["text"].isNull() | s["score"].isNull())),
        ("total_ms", latency["total_ms"].isNull() | (latency["total_ms"] < 0)),
        ("stage_ms", stage),
    ])


# Keys each client event may have.
_CLIENT_KEYS = {"session_start": ["type", "request_id", "language", "session_id"], "audio_end": ["type", "request_id"], "cancel": ["type", "request_id"]}


def _parsed(json: Column, names: list[str], body) -> Column:
    """body(fields, keys) with the JSON parsed once: fields as strings by name, keys null if json is no object."""
    fields = F.from_json(json, ", ".join(f"{n} string" for n in names))
    return F.transform(F.array(F.struct(fields.alias("f"), F.json_object_keys(json).alias("k"))), lambda s: body(lambda n: s["f"][n], s["k"]))[0]


def client_event(json: Column, strict: bool = True) -> Column:
    """strict follows the contract (no further keys), lenient the running service."""

    def check(get, keys: Column) -> Column:
        kind = get("type")
        known = F.coalesce(kind.isin(CLIENT_EVENTS), F.lit(False))
        start = F.coalesce(kind == "session_start", F.lit(False))
        rules = [
            ("type", ~known),
            ("request_id", known & _missing(get("request_id"))),
            ("language", start & (~F.array_contains(keys, "language") | ~get("language").isin(LOCALES))),
            ("session_id", start & (F.length(get("session_id")) == 0)),
        ]
        if strict:
            extra = F.lit(False)
            for k, allowed in _CLIENT_KEYS.items():
                extra = extra | ((kind == k) & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0))
            rules.append(("extra", known & extra))
        return F.when(keys.isNull(), F.lit("json")).otherwise(_violated(rules))

    return _parsed(json, ["type", "request_id", "language", "session_id"], check)


def server_event(kind: Column, request_id: Column, timestamp: Column, data: Column) -> Column:
    """The evident intent of the contract: envelope and data of the event's kind (data: JSON string)."""

    def check(get, keys: Column) -> Column:
        return _violated([
            ("type", kind.isNull() | ~kind.isin(SERVER_EVENTS)),
            ("request_id", _missing(request_id)),
            ("timestamp", timestamp.isNull() | F.try_to_timestamp(timestamp).isNull()),
            ("stage", (kind == "processing") & (get("stage").isNull() | ~get("stage").isin(STAGES))),
            ("code", (kind == "error") & (get("code").isNull() | ~get("code").isin(ERROR_CODES))),
            ("message", (kind == "error") & _missing(get("message"))),
            ("retryable", (kind == "error") & F.array_contains(keys, "retryable") & (get("retryable").isNull() | ~get("retryable").isin("true", "false"))),
            ("status", (kind == "complete") & (get("status").isNull() | ~get("status").isin(COMPLETIONS))),
            ("text", (kind == "transcript") & get("text").isNull()),
        ])

    return _parsed(data, ["stage", "code", "message", "retryable", "status", "text"], check)
