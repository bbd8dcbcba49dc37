"""The session machine: scripts, batch against stream."""

import json

import pandas as pd

from ragloom.operators import sessions
from ragloom.operators.sessions import Limits, State, step

START = json.dumps({"type": "session_start", "request_id": "r1", "language": "hi-IN", "session_id": "s"})
END = json.dumps({"type": "audio_end", "request_id": "r1"})
CANCEL = json.dumps({"type": "cancel", "request_id": "other"})


def run(*messages):
    state, out = State(), []
    for m in messages:
        kind, size, payload = ("binary", m, None) if isinstance(m, int) else ("disconnect", 0, None) if m is None else ("text", 0, m)
        out += [(t, r, d) for t, r, d in step(state, kind, size, payload, Limits(audio=1000))]
    return out, state


def test_happy_path():
    out, state = run(START, 500, 500, END)
    assert [t for t, _, _ in out] == ["transcript", *["processing"] * 6, "answer", "complete"]
    assert out[-2] == ("answer", "r1", "1000") and out[-1] == ("complete", "r1", "success") and not state.active


def test_audio_before_start_is_an_error_without_complete():
    assert run(5)[0] == [("error", "unknown", "INVALID_REQUEST")]


def test_second_start_resets_the_buffer():
    assert run(START, 900, START, 7, END)[0][-2] == ("answer", "r1", "7")


def test_unsupported_locale_ends_the_session():
    bad = START.replace("hi-IN", "fr-FR")
    assert run(bad, END)[0] == [("error", "r1", "UNSUPPORTED_LANGUAGE"), ("complete", "r1", "failed")]


def test_end_while_idle_is_ignored_and_cancel_always_answers():
    assert run(END)[0] == []
    assert run(CANCEL)[0] == [("complete", "other", "cancelled")]
    assert run('{"type":"cancel"}')[0] == [("complete", "", "cancelled")]
    assert run(START, 5, CANCEL, END)[0] == [("complete", "other", "cancelled")]


def test_empty_and_oversize_audio_fail():
    for frames in ([], [1001]):
        assert run(START, *frames, END)[0] == [("error", "r1", "INVALID_REQUEST"), ("complete", "r1", "failed")]


def test_broken_json_non_objects_and_unknown_types():
    assert run("{x")[0] == run("[1]")[0] == [("error", "unknown", "INVALID_REQUEST")]
    assert run('{"type":"hello"}')[0] == []


def test_mismatched_end_is_reported_and_disconnect_closes():
    out, _ = run(START, 1, '{"type":"audio_end","request_id":"x"}')
    assert out[0] == ("warning", "r1", "REQUEST_ID_MISMATCH") and out[-1][2] == "success"
    assert run(START, 1, None, END)[0] == []


def _rows():
    rows = []
    for c in ("a", "b"):
        for i, m in enumerate([5, START, 10, 20, END, CANCEL, "{x", START, END, None, START]):
            kind, size, payload = ("binary", m, None) if isinstance(m, int) else ("disconnect", None, None) if m is None else ("text", None, m)
            rows.append((c, i, kind, size, payload))
    return rows


SCHEMA = "connection string, seq long, kind string, bytes long, payload string"


def test_stream_equals_batch(spark, tmp_path):
    from ragloom.streaming import sessions as streaming

    df = spark.createDataFrame(_rows(), SCHEMA)
    want = {tuple(r) for r in sessions.machine(df).collect()}
    assert want
    for lo, hi in ((0, 4), (4, 7), (7, 99)):  # three files, so state must outlive a batch
        df.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.once(stream, lambda b, _: got.extend(tuple(r) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert set(got) == want and len(got) == len(want)


def test_null_connection_and_empty_table(spark):
    df = spark.createDataFrame([(None, 1, "text", None, START)], SCHEMA)
    assert sessions.machine(df).count() == 0
    assert sessions.buffered(df.where("seq > 9")).count() == 0


def test_fold_orders_by_seq():
    rows = pd.DataFrame([("a", 2, "text", None, END), ("a", 0, "text", None, START), ("a", 1, "binary", 9, None)], columns=["connection", "seq", "kind", "bytes", "payload"])
    assert sessions.fold(rows, State())["type"].iloc[-1] == "complete"


def test_starts_without_id_get_their_own_and_connections_return():
    bare = '{"type":"session_start"}'
    rows = pd.DataFrame([("a", 0, "text", None, bare), ("a", 1, "binary", 9, None), ("a", 2, "text", None, END), ("a", 3, "disconnect", None, None), ("a", 4, "text", None, bare), ("a", 5, "binary", 9, None), ("a", 6, "text", None, END)], columns=["connection", "seq", "kind", "bytes", "payload"])
    done = sessions.fold(rows, State())
    ids = done[done["type"] == "complete"]["request_id"].tolist()
    assert len(ids) == len(set(ids)) == 2 and list(done[done["type"] == "complete"]["detail"]) == ["success"] * 2


def test_state_is_dropped_after_a_disconnect():
    state = State()
    for kind, payload in (("text", START), ("disconnect", None)):
        step(state, kind, 0, payload)
    assert state == State()
