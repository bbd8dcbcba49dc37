"""Retrieval, index, providers, files, streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ragloom.operators import answers, index, ingest, metrics, retrieval
from ragloom.sources import files, providers


def test_topk_against_numpy_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    q, c = rng.standard_normal((7, 8)), rng.standard_normal((300, 8))
    c[5] = 0
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "ROUND", 2)
    got = retrieval.topk(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(900, None), (901, [1.0])], "id long, vector array<double>"), 5).collect()
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ np.divide(c, np.linalg.norm(c, axis=1)[:, None], where=np.linalg.norm(c, axis=1)[:, None] > 0, out=np.zeros_like(c)).T, 6)
    want = {(i, int(j), r + 1) for i in range(7) for r, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:5])}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == want


def test_ties_go_to_the_smaller_id_and_empty_inputs(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7)], "id long, vector array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [r["item_id"] for r in retrieval.topk(q, same, 2).orderBy("rank").collect()] == [3, 7]
    assert retrieval.topk(q.where("query_id > 5"), same, 2).count() == retrieval.topk(q, same.where("id > 99"), 2).count() == 0


@pytest.mark.parametrize("floor", [None, 0.25])
def test_a_task_keeps_k_rows_a_query_however_many_tie(monkeypatch, floor):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((400, 4))
    c[rng.random(400) < 0.5] = c[7]  # half are copies
    q, ids = c[[7, 8, 9]], rng.permutation(400)
    unit = retrieval._unit(list(q))
    batches = [pd.DataFrame({"id": ids[a : a + 90], "vector": list(c[a : a + 90])}) for a in range(0, 400, 90)]
    monkeypatch.setattr(retrieval, "SCORES", 24)
    (got,) = retrieval._best(iter(batches), np.array([5, 6, 7]), unit, 6, floor)
    s = np.round(unit @ retrieval._unit(list(c)).T, 6)
    want = [(5 + i, int(ids[j]), s[i, j]) for i in range(3) for j in sorted(range(400), key=lambda j: (-s[i, j], ids[j]))[:6] if floor is None or s[i, j] >= floor]
    assert list(got.itertuples(index=False, name=None)) == want
    (none,) = retrieval._best(iter([]), np.array([5]), unit[:1], 6, floor)
    assert len(none) == 0


def test_reranking_permutes(spark):
    hits = spark.createDataFrame([(0, i, i / 10, 10 - i) for i in range(10)], "query_id long, item_id long, score double, rank int")
    out = retrieval.rerank(hits, -F.col("score"), 10)
    assert retrieval.rerank_faults(hits, out).count() == 0
    assert out.where("rank = 1").first()["item_id"] == 0


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, item_id long, rank int")
    judged = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 5)], "query_id long, item_id long")
    a, b = metrics.per_query(ranking, judged, 3).orderBy("query_id").collect()
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(4), 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert (a["relevant"], a["hits"], a["recall"], a["rr"]) == (3, 2, 0.666667, 0.5) and a["ndcg"] == pytest.approx(dcg / ideal, abs=1e-6)
    assert (b["recall"], b["rr"], b["ndcg"]) == (0, 0, 0)


def test_upsert_is_idempotent(spark):
    p = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "point_id string, version int, x double")
    c = spark.createDataFrame([("b", 2, 3.0), ("c", 1, 4.0)], "point_id string, version int, x double")
    once, twice = index.upsert(p, c), index.upsert(index.upsert(p, c), c)
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0 and once.count() == 3


def test_snapshot_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("a", [1.0, 0.0])], "point_id string, vector array<double>")
    index.write_snapshot(p, f"file://{tmp_path}/i", {"model": "m"})
    back, meta = index.read_snapshot(spark, f"file://{tmp_path}/i")
    assert meta["points"] == 1 and meta["model"] == "m" and back.collect() == p.collect()
    assert index.verify(back, 2, 1).first()["ready"] and not index.verify(back, 2, 2).first()["ready"] and not index.verify(back, 3, 1).first()["ready"]


@pytest.mark.parametrize("automaton", [True, False])
def test_heldout_in_blocks(spark, monkeypatch, automaton):
    monkeypatch.setattr(ingest, "HELDOUT_ROWS", 2)
    monkeypatch.setattr(ingest, "ahocorasick", ingest.ahocorasick if automaton else None)
    docs = spark.createDataFrame([(1, "xx alpha yy"), (2, "beta"), (3, "gamma"), (4, None)], "doc_id long, text string")
    held = spark.createDataFrame([("alpha",), ("beta",), ("delta",), (None,), ("",)], "text string")
    assert sorted(r[0] for r in ingest.exclude_heldout(docs, held).select("doc_id").collect()) == [3, 4]


def test_outcomes(spark):
    rows = [(0, None, True, True), (2, None, True, True), (2, None, True, False), (2, None, True, None), (2, "timeout", True, True), (2, "x", True, True)]
    df = spark.createDataFrame(rows, "e int, f string, a boolean, v boolean")
    got = [tuple(r) for r in df.select(*answers.outcome(F.col("e"), F.col("f"), F.col("a"), F.col("v"))).collect()]
    assert got == [("NO_RELEVANT_CONTEXT", "failed", False), (None, "success", True), (None, "success", False), (None, "success", False), ("RAG_TIMEOUT", "failed", False), ("RAG_ERROR", "failed", False)]


def test_retries_and_classes():
    waits, tries = [], []

    def call(error):
        tries.append(1)
        raise error

    with pytest.raises(providers.ProviderError):
        providers.with_retries(lambda: call(providers.classify(503)), sleep=waits.append)
    assert len(tries) == 3 and waits == [1.0, 2.0]
    tries.clear()
    with pytest.raises(providers.ProviderError) as e:
        providers.with_retries(lambda: call(providers.classify(404)), sleep=waits.append)
    assert len(tries) == 1 and not e.value.retryable
    assert providers.classify(200) is None and providers.classify(None).retryable and providers.classify(None, timed_out=True).code == "STT_TIMEOUT"


def test_selection_fails_closed():
    live = providers.Provider("live", lambda: dict)
    assert providers.select_stt(False).fixture and providers.select_stt(True, exact=live) is live and providers.select_stt(False, None, None, live) is live
    for bad in (lambda: providers.select_stt(True), lambda: providers.select_stt(True, "mock", live), lambda: providers.select_engine(True)):
        with pytest.raises(ValueError):
            bad()
    assert providers.endpoint("http://x/") == "http://x"


def test_provider_rows_and_errors(spark):
    df = spark.createDataFrame([(bytearray(b"hello"), "hi"), (bytearray(b""), "en")], "audio binary, language string")

    def start():
        def call(row):
            if not row["audio"]:
                raise providers.ProviderError("STT_ERROR", "no audio", False, 400)
            return {"transcript": bytes(row["audio"]).decode()}

        return call

    got = providers.apply(df, providers.Provider("p", start), {"transcript": "string"}).select("transcript", "error_code", "retryable").collect()
    assert {tuple(r) for r in got} == {("hello", None, None), (None, "STT_ERROR", False)}


def test_jsonl_is_the_same_twice_and_audio_files(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f"t{i}") for i in range(50)], "id long, t string")
    for name in ("a", "b"):
        files.write_jsonl(df.repartition(3 if name == "a" else 5), str(tmp_path / name), "id")
    assert files.jsonl_hash(tmp_path / "a") == files.jsonl_hash(tmp_path / "b")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.wav").write_bytes(b"RIFF" + b"0" * 60)
    (tmp_path / "w" / "y.bin").write_bytes(b"abc")
    got = {r["path"][-5:]: (r["mime"], r["fault"], r["duration_ms"]) for r in files.read_audio(spark, str(tmp_path / "w")).collect()}
    assert got == {"x.wav": ("audio/wav", None, 2), "y.bin": (None, None, 0)}


def test_stream_windows_and_interval_join(spark, tmp_path):
    from ragloom.streaming import sessions as streaming

    e = spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 600) AS ts, 'a' AS event_type, 1.0D AS value, 1L AS user_id FROM range(30)")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = streaming.per_window(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streaming.per_window(e).collect()))
    f, s = stream.selectExpr("user_id AS connection", "ts", "event_id"), stream.where("event_id = 0").selectExpr("user_id AS connection", "ts AS started")
    q = streaming.joined(f, s).writeStream.format("memory").queryName("j").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("j").count() == 7
