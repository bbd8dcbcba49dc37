"""The engine end to end on a literal corpus."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ragloom.engine import CHUNKERS, Engine, Parts, Settings
from ragloom.functions import text as T
from ragloom.operators import metrics
from ragloom.operators.sessions import Limits, State, step
from ragloom.sources import http, providers


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([(1, "s", "The red fox sleeps. The blue whale swims in the deep sea."), (2, "s", "Mountains rise over quiet valleys."), (3, "s", "held out secret text"), (4, "s", None)], "doc_id long, source string, text string")
    held = spark.createDataFrame([("secret",)], "text string")
    settings = Settings(floor=0.3)
    points = Engine.index(docs, settings, held)
    return Engine(spark, points, settings, expected=points.count())


QUERY = "request_id string, query string, language string, top_k int, session_id string"


def test_outcomes_of_requests(spark, engine):
    rows = [("a", "blue whale deep sea", "en-IN", None, None), ("b", "zzz qqq", "en-IN", 5, None), ("c", "", "en-IN", 5, None), ("d", "fox", "fr-FR", 5, None), ("e", "quiet mountains valleys", None, 1, "s"), ("f", "x" * 2001, "hi-IN", 5, None), ("g", "fox", "en-IN", 21, None)]
    got = {r["request_id"]: r for r in engine.answer(spark.createDataFrame(rows, QUERY)).collect()}
    assert len(got) == 7
    assert got["a"]["answer"] == "The blue whale swims in the deep sea." and got["a"]["grounded"] and got["a"]["status"] == "success"
    assert got["e"]["answer"] == "Mountains rise over quiet valleys." and len(got["e"]["sources"]) == 1 and got["e"]["language"] == "en-IN"
    assert {k: got[k]["error_code"] for k in "bcdfg"} == {"b": "NO_RELEVANT_CONTEXT", "c": "INVALID_REQUEST", "d": "UNSUPPORTED_LANGUAGE", "f": "INVALID_REQUEST", "g": "INVALID_REQUEST"}
    assert not any(got[k]["grounded"] for k in "bcdfg")


def test_heldout_is_not_indexed_and_status(engine):
    assert engine.points.where("text LIKE '%secret%'").count() == 0
    s = engine.status().first()
    assert s["ready"] and s["stt_provider"] == "fixture"


def test_audio(spark, engine):
    rows = [("a", bytearray(b"blue whale"), "en"), ("b", bytearray(b""), "en"), ("c", bytearray(b"fox"), "xx"), ("d", bytearray(b"  "), "en")]
    got = {r["request_id"]: r for r in engine.answer_audio(spark.createDataFrame(rows, "request_id string, audio binary, language string")).collect()}
    assert got["a"]["status"] == "success" and got["a"]["language"] == "en-IN"
    assert [got[k]["error_code"] for k in "bcd"] == ["INVALID_REQUEST", "UNSUPPORTED_LANGUAGE", "INVALID_REQUEST"]


def test_settings_and_production():
    s = Settings.from_env({"RAGLOOM_FLOOR": "0.5", "RAGLOOM_RERANK": "false", "RAGLOOM_FETCH_K": "7", "RAGLOOM_PRODUCTION": "1"})
    assert (s.floor, s.rerank, s.fetch_k, s.production) == (0.5, False, 7, True)
    with pytest.raises(ValueError):
        Engine(None, None, s)


def test_small_parts(spark):
    assert providers.form_fields("sarvam", "m", "hi-IN", "transcribe") == {"model": "m", "mode": "transcribe", "language_code": "hi-IN"}
    assert providers.form_fields("voxtral", "m", None, "x") == {"model": "m"}
    r = spark.range(1).select(metrics.throughput(F.lit(10), F.lit(4)).alias("a"), metrics.throughput(F.lit(1), F.lit(0)).alias("b"), T.preview(F.lit("x" * 99)).alias("c")).first()
    assert (r["a"], r["b"], len(r["c"])) == (2.5, None, 80)
    s = State(active=True, request_id="r")
    assert step(s, "binary", 10, None, Limits(frame=9)) == [("error", "r", "INVALID_REQUEST")] and s.size == 0
    step(s, "binary", 64, None)
    assert step(s, "text", 0, '{"type":"audio_end"}', Limits(ms=1))[-1] == ("complete", "r", "failed")


class Remote(BaseHTTPRequestHandler):
    """An engine and a speech-to-text service; the query or the audio says how to behave."""

    def log_message(self, *given):
        pass

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path == "/stt":
            status, out = 200, {"transcript": "blue whale", "language_code": "hi"} if b"fine" in body and self.headers["api-subscription-key"] == "k" else {"text": 1}
        else:
            asked = json.loads(body)
            status = {"down": 503, "bad": 404}.get(asked["query"], 200)
            out = {"answer": f"{asked['query']} {asked['top_k']}", "language": asked["language"], "grounded": True, "sources": [{"id": "1", "text": "t", "score": 0.5}], "latency": {"total_ms": 12.5, "reranking_ms": None}}
            if asked["query"] == "broken":
                del out["answer"]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())


@pytest.fixture(scope="module")
def remote():
    server = HTTPServer(("127.0.0.1", 0), Remote)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_engine(spark, engine, remote, monkeypatch):
    monkeypatch.setattr(providers, "LEAST_WAIT", 0.0)
    client = http.engine(remote + "/", 5)
    asked = Engine(spark, engine.points, Settings(production=True), stt=http.stt("sarvam", remote + "/stt", "k", "m"), remote=client, expected=1)
    rows = [("a", "hello", "en-IN", 7, None), ("b", "bad", "en-IN", 5, None), ("c", "broken", "en-IN", 5, None), ("d", "", "en-IN", 5, None)]
    got = {r["request_id"]: r for r in asked.answer(spark.createDataFrame(rows, QUERY)).collect()}
    assert got["a"]["answer"] == "hello 7" and got["a"]["grounded"] and got["a"]["latency"]["total_ms"] == 12.5 and got["a"]["latency"]["reranking_ms"] is None and got["a"]["sources"][0]["score"] == 0.5
    assert {k: got[k]["error_code"] for k in "bcd"} == {"b": "RAG_ERROR", "c": "RAG_ERROR", "d": "INVALID_REQUEST"}
    status = asked.status().first()
    assert status["ready"] and not status["index_ready"] and status["stt_provider"] == "sarvam"
    audio = spark.createDataFrame([("x", bytearray(b"fine"), "en", 3), ("y", bytearray(b"odd"), "en", 3)], "request_id string, audio binary, language string, top_k int")
    spoken = {r["request_id"]: r for r in asked.answer_audio(audio).collect()}
    assert (spoken["x"]["answer"], spoken["x"]["language"], spoken["y"]["error_code"]) == ("blue whale 3", "hi-IN", "STT_ERROR")


def test_failures_of_requests(remote):
    for body, code, again in (({"query": "down"}, "RAG_ERROR", True), ({"query": "bad"}, "RAG_ERROR", False)):
        with pytest.raises(providers.ProviderError) as e:
            http.engine(remote).start()(body | {"request_id": "r", "language": "en-IN", "top_k": 1})
        assert (e.value.code, e.value.retryable) == (code, again)
    with pytest.raises(providers.ProviderError) as e:
        http.engine("http://127.0.0.1:9").start()({"request_id": "r", "query": "q", "language": "en-IN", "top_k": 1})
    assert e.value.code == "RAG_ERROR" and e.value.retryable and not http.healthy("http://127.0.0.1:9")
    assert http.from_env({}) == (None, None, None)
    assert [p.name for p in http.from_env({"RAGLOOM_SARVAM_KEY": "k", "RAGLOOM_VOXTRAL_KEY": "k", "RAGLOOM_ENGINE_URL": "u"})] == ["sarvam", "voxtral", "http"]


def test_any_error_of_a_provider_fails_its_row(spark):
    def start():
        def call(row):
            if row["id"] == 1:
                raise KeyError("x")
            return {"out": "fine"}

        return call

    got = {r["id"]: r for r in providers.apply(spark.range(3), providers.Provider("p", start), {"out": "string"}, kind="RAG").collect()}
    assert [got[i]["error_code"] for i in range(3)] == [None, "RAG_ERROR", None] and got[1]["retryable"] and got[0]["out"] == "fine" and got[0]["elapsed_ms"] >= 0


def test_parts_and_readiness(spark, tmp_path):
    from ragloom.operators import index

    docs = spark.createDataFrame([(1, "s", "One fox. Two whales.")], "doc_id long, source string, text string")
    parts = Parts(chunk=CHUNKERS["sentence"], generate=lambda question, evidence: F.concat(F.lit("made of "), F.array_join(evidence, "|")), fixtures=())
    settings = Settings(floor=0.1, chunk=10, production=True)
    stt = providers.Provider("live", lambda: lambda row: {})
    points = Engine.index(docs, settings, parts=parts)
    assert sorted(r["text"] for r in points.collect()) == ["One fox.", "Two whales."]
    index.write_snapshot(points, str(tmp_path / "i"), {"model": "m"})
    engine = Engine.load(spark, str(tmp_path / "i"), settings, stt=stt, parts=parts)
    answer = engine.answer(spark.createDataFrame([("a", "fox", None, None, None)], QUERY)).first()
    assert answer["answer"] == "made of One fox." and answer["latency"]["total_ms"] is None
    assert engine.status().first()["ready"]
    assert not Engine(spark, points.limit(1), settings, stt=stt, parts=parts, expected=2).status().first()["ready"]
    with pytest.raises(ValueError):
        Engine(spark, points, settings, stt=stt)  # the default parts are fixtures
    near = spark.createDataFrame([(1, "s", "red fox runs. red fox sleeps. blue whales swim."), (2, "s", "")], "doc_id long, source string, text string")
    assert sorted(r["text"] for r in Engine.index(near, settings, parts=Parts(chunk=CHUNKERS["semantic"])).collect()) == ["blue whales swim.", "red fox runs. red fox sleeps."]


def test_hydration_shuffles_no_payload_but_the_hits(spark):
    from ragloom.operators import retrieval

    hits = spark.createDataFrame([(1, 5, 0.5, 1), (1, 99, 0.4, 2)], "query_id long, item_id long, score double, rank int")
    payload = spark.range(50).select(F.col("id").alias("item_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    for most in (None, 2, 10**9):
        assert sorted((r["item_id"], r["text"]) for r in retrieval.hydrate(hits, payload, most).collect()) == [(5, "text 5"), (99, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = retrieval.hydrate(hits, payload, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [item_id" in plan.split("Range (0, 50")[0]  # between the payload's scan and its shuffle


@pytest.mark.parametrize("groups", [0, 50_000])
def test_percentiles_equal_numpy(spark, groups, monkeypatch):
    import numpy as np

    monkeypatch.setattr(metrics, "BROADCAST_GROUPS", groups)

    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.exponential(9, 5000)] + [("b", 3.0)] * 7 + [("c", float(x)) for x in (1, 2)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in metrics.percentiles(df, ["k"], "v", metrics.PERCENTILES).collect():
        v = [x for k, x in rows if k == r["k"] and x is not None]
        assert r["requests"] == len(v) and [r[p] for p in metrics.PERCENTILES] == pytest.approx([np.quantile(v, q) for q in metrics.PERCENTILES.values()], abs=2e-6)
