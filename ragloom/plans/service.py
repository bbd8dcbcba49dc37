"""Queries over sessions, outcomes and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.functions import contracts as rules
from ragloom.functions.fixed import COMPLETIONS, ERRORS, PROVIDER_MS, SLO_MS, STAGES
from ragloom.operators import answers, metrics, sessions
from ragloom.plans.fixtures import SQL_LATENCIES, SQL_MESSAGES, latencies, messages, pick, table
from ragloom.plans.registry import query
from ragloom.streaming import sessions as streaming


@query(f"WITH {SQL_MESSAGES} SELECT connection, kind, count(*) AS messages, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM msg GROUP BY connection, kind")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("connection", "kind").agg(F.count("*").alias("messages"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


_SQL_SEGMENTS = f"{SQL_MESSAGES}, seg AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY connection ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM msg)"


@query(f"WITH {_SQL_SEGMENTS} SELECT connection, seq, session::BIGINT AS session FROM seg")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.segments(messages(spark, sf_dir)).select("connection", "seq", "session")


@query(f"WITH {_SQL_SEGMENTS} SELECT connection, session::BIGINT AS session, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (kind = 'binary') AS frames FROM seg WHERE session > 0 GROUP BY connection, session")
def session_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.buffered(messages(spark, sf_dir))


_STEPS = ", ".join(f"'{s}'" for s in sessions.RUN_STAGES)
# The machine once more, by what the last control event before a message was.
_SQL_MACHINE = f"""{SQL_MESSAGES},
    ctl AS (SELECT *, CASE WHEN event_type = 'signup' THEN CASE WHEN locale = 'fr-FR' THEN 'bad' ELSE 'start' END WHEN event_type = 'purchase' THEN 'end' WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'cancel' END AS ctl,
        event_type = 'error' AND event_id % 5 = 0 AS broken, sum((event_type = 'signup')::INT) OVER (PARTITION BY connection ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM msg),
    w AS (SELECT *, coalesce(last_value(ctl IGNORE NULLS) OVER p = 'start', false) AS active, last_value(CASE WHEN event_type = 'signup' THEN 'r' || event_id END IGNORE NULLS) OVER p AS rid,
        last_value(CASE WHEN event_type = 'signup' THEN locale END IGNORE NULLS) OVER p AS lang, coalesce(sum(bytes) OVER (PARTITION BY connection, session ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS size
        FROM ctl WINDOW p AS (PARTITION BY connection ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ended AS (SELECT *, (event_id % 7 = 0 AND 'other' <> rid)::INT AS m, size > 0 AND size <= 26214400 AS fine FROM w WHERE ctl = 'end' AND active),
    events_out AS (
        SELECT connection, seq, 0 AS ordinal, 'error' AS type, coalesce(rid, 'unknown') AS request_id, 'INVALID_REQUEST' AS detail FROM w WHERE broken OR (kind = 'binary' AND bytes > 0 AND NOT active)
        UNION ALL SELECT connection, seq, 0, 'error', 'r' || event_id, 'UNSUPPORTED_LANGUAGE' FROM w WHERE ctl = 'bad'
        UNION ALL SELECT connection, seq, 1, 'complete', 'r' || event_id, 'failed' FROM w WHERE ctl = 'bad'
        UNION ALL SELECT connection, seq, 0, 'complete', CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE coalesce(rid, '') END, 'cancelled' FROM w WHERE ctl = 'cancel'
        UNION ALL SELECT connection, seq, 0, 'warning', rid, 'REQUEST_ID_MISMATCH' FROM ended WHERE m = 1
        UNION ALL SELECT connection, seq, m, 'error', rid, 'INVALID_REQUEST' FROM ended WHERE NOT fine
        UNION ALL SELECT connection, seq, m + 1, 'complete', rid, 'failed' FROM ended WHERE NOT fine
        UNION ALL SELECT connection, seq, m, 'transcript', rid, lang FROM ended WHERE fine
        UNION ALL SELECT connection, seq, m + i, 'processing', rid, [{_STEPS}][i] FROM ended, range(1, {len(sessions.RUN_STAGES) + 1}) r(i) WHERE fine
        UNION ALL SELECT connection, seq, m + {len(sessions.RUN_STAGES) + 1}, 'answer', rid, size::BIGINT::VARCHAR FROM ended WHERE fine
        UNION ALL SELECT connection, seq, m + {len(sessions.RUN_STAGES) + 2}, 'complete', rid, 'success' FROM ended WHERE fine)"""


@query(f"WITH {_SQL_MACHINE} SELECT connection, seq, ordinal::INT AS ordinal, type, request_id, detail FROM events_out")
def session_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.machine(messages(spark, sf_dir))


_SQL_DATA = f"""CASE type WHEN 'processing' THEN '{{"stage":"' || detail || '"}}' WHEN 'complete' THEN '{{"status":"' || detail || '"}}'
    WHEN 'error' THEN '{{"code":"' || detail || '","message":"' || lower(replace(detail, '_', ' ')) || '","retryable":false}}'
    WHEN 'transcript' THEN '{{"text":"","language":"' || detail || '","is_final":true}}'
    WHEN 'answer' THEN '{{"answer":"' || detail || ' bytes of audio","grounded":false,"sources":[]}}' END"""


@query(f"""WITH {_SQL_MACHINE}, e AS (SELECT *, strftime(make_timestamp((seq // 1000)), '%Y-%m-%dT%H:%M:%S') || 'Z' AS stamp, {_SQL_DATA} AS data FROM events_out WHERE type <> 'warning')
    SELECT connection, seq, ordinal::INT AS ordinal, '{{"type":"' || type || '","request_id":"' || request_id || '","timestamp":"' || stamp || '","data":' || data || '}}' AS json, CASE WHEN request_id = '' THEN 'request_id' ELSE '' END AS violations FROM e""")
def server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of event as JSON, and the rules of the contract that each violates: only a cancel before any start,
    which has no request to name."""
    at = F.date_format(F.timestamp_micros(F.expr("seq div 1000")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = sessions.wire(sessions.machine(messages(spark, sf_dir)), at)
    return e.select("connection", "seq", "ordinal", "json", rules.server_event(F.col("type"), F.col("request_id"), F.col("timestamp"), F.col("data")).alias("violations"))


@query(f"SELECT event_id, i::INT AS position, [{', '.join(repr(s) for s in STAGES)}][i + 1] AS stage FROM events, range(0, {len(STAGES)}) r(i) WHERE event_type = 'purchase'")
def processing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.posexplode(F.array(*map(F.lit, STAGES))).alias("position", "stage"))


@query(f"WITH {SQL_MESSAGES}, l AS (SELECT connection, seq, event_type, lag(event_type) OVER (PARTITION BY connection ORDER BY seq) AS before FROM msg WHERE kind = 'text') SELECT connection, seq, event_type FROM l WHERE event_type = before")
def duplicate_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(~F.col("event_type").isin("view", "click"))
    named = e.select(F.col("user_id").cast("string").alias("connection"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"), "event_type")
    before = F.lag("event_type").over(W.partitionBy("connection").orderBy("seq"))
    return named.withColumn("_b", before).where("event_type = _b").drop("_b")


@query(f"""WITH {_SQL_MACHINE}, started AS (SELECT connection, 'r' || event_id AS request_id FROM msg WHERE event_type = 'signup')
    SELECT connection, request_id FROM started s WHERE NOT EXISTS (SELECT 1 FROM events_out e WHERE e.type = 'complete' AND e.connection = s.connection AND e.request_id = s.request_id)""")
def unterminated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    started = m.where(F.get_json_object("payload", "$.type") == "session_start").select("connection", F.get_json_object("payload", "$.request_id").alias("request_id"))
    done = sessions.machine(m).where("type = 'complete'").select("connection", "request_id")
    return started.join(done, ["connection", "request_id"], "left_anti")


@query(f"WITH {_SQL_MACHINE} SELECT detail AS status, count(*) AS requests FROM events_out WHERE type = 'complete' GROUP BY detail")
def completion_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sessions.machine(messages(spark, sf_dir)).where("type = 'complete'")
    return done.where(F.col("detail").isin(COMPLETIONS)).groupBy(F.col("detail").alias("status")).agg(F.count("*").alias("requests"))


_CODES = "[" + ", ".join(f"'{c}'" for c in ERRORS) + "]"


@query(f"SELECT {_CODES}[(event_id % 7 + 1)::INT] AS code, event_id % 7 BETWEEN 2 AND 5 AS retryable, count(*) AS failures, round(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures among all requests, in one pass: each group's count and the number of all rows."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", pick(list(ERRORS), F.col("event_id") % 7)).alias("code"))
    counts = e.groupBy("code").agg(F.count("*").alias("failures"))
    retry = F.col("code").isin([c for c, (_, r) in ERRORS.items() if r])
    whole = counts.agg(F.sum("failures").alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).where("code IS NOT NULL").select("code", retry.alias("retryable"), "failures", F.round(F.col("failures") / F.col("_all"), 6).alias("rate"))


@query(f"""WITH {SQL_LATENCIES} SELECT event_type, count(*) AS requests, round(quantile_cont(total_ms, 0.5), 6) AS p50, round(quantile_cont(total_ms, 0.7), 6) AS p70, round(quantile_cont(total_ms, 0.95), 6) AS p95, round(max(total_ms), 6) AS p100 FROM lat GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(latencies(spark, sf_dir), ["event_type"], "total_ms", metrics.PERCENTILES).drop("_least", "_most")


@query(f"WITH {SQL_LATENCIES} SELECT event_type, max(total_ms) AS p100, max(total_ms) < {SLO_MS} AS met, count(*) FILTER (total_ms >= {SLO_MS}) AS over FROM lat WHERE event_type <> 'error' GROUP BY event_type")
def slo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = latencies(spark, sf_dir).where("event_type != 'error'")
    return done.groupBy("event_type").agg(F.max("total_ms").alias("p100"), (F.max("total_ms") < SLO_MS).alias("met"), F.count(F.when(F.col("total_ms") >= SLO_MS, 1)).alias("over"))


@query(f"WITH {SQL_LATENCIES} SELECT event_type, count(*) AS requests, count(*) FILTER (total_ms >= {SLO_MS}) AS late, count(*) FILTER (generation_ms > {PROVIDER_MS}) AS provider_late FROM lat GROUP BY event_type")
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and provider calls beyond their deadlines, as measured: rows of a batch are not cut off."""
    late = lambda bad: F.count(F.when(bad, 1))
    return latencies(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("requests"), late(F.col("total_ms") >= SLO_MS).alias("late"), late(F.col("generation_ms") > PROVIDER_MS).alias("provider_late"))


_STAGE_MS = ["embedding_ms", "retrieval_ms", "reranking_ms", "generation_ms"]


@query(f"WITH {SQL_LATENCIES}, u AS (UNPIVOT (SELECT {', '.join(_STAGE_MS)} FROM lat) ON {', '.join(_STAGE_MS)} INTO NAME stage VALUE ms) SELECT stage, count(*) AS measured, round(avg(ms), 4) AS mean_ms, round(max(ms), 4) AS most_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM u GROUP BY stage")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = latencies(spark, sf_dir).select(*_STAGE_MS).unpivot([], _STAGE_MS, "stage", "ms").where("ms IS NOT NULL")
    means = tall.groupBy("stage").agg(F.round(F.avg("ms"), 4).alias("mean_ms"))
    ranks = metrics.percentiles(tall, ["stage"], "ms", {"p95_ms": 0.95}, 4)
    return ranks.join(means, "stage").select("stage", F.col("requests").alias("measured"), "mean_ms", F.round("_most", 4).alias("most_ms"), "p95_ms")


@query(f"WITH {SQL_LATENCIES}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS cold FROM lat) SELECT cold, count(*) AS requests, round(quantile_cont(total_ms, 0.5), 6) AS p50, round(max(total_ms), 6) AS p100 FROM c GROUP BY cold")
def cold_steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user stands for a process; its first request is cold."""
    first = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = latencies(spark, sf_dir).withColumn("cold", F.row_number().over(first) == 1)
    return metrics.percentiles(rows, ["cold"], "total_ms", {"p50": 0.5, "p100": 1.0}).select("cold", "requests", "p50", "p100")


_SUM_MS = "embedding_ms + retrieval_ms + coalesce(reranking_ms, 0) + generation_ms"


@query(f"WITH {SQL_LATENCIES} SELECT event_id, round(total_ms - ({_SUM_MS}), 4) AS overhead_ms, {_SUM_MS} <= total_ms AS parts_fit FROM lat")
def latency_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.expr(_SUM_MS)
    return latencies(spark, sf_dir).select("event_id", F.round(F.col("total_ms") - parts, 4).alias("overhead_ms"), (parts <= F.col("total_ms")).alias("parts_fit"))


@query("SELECT event_id, user_id, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000.0, 1) AS stage_ms FROM events")
def stage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", micros.alias("_t"))
    after = F.lead("_t").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", F.round((after - F.col("_t")) / 1000.0, 1).alias("stage_ms"))


@query("""SELECT ['GET', 'POST'][(event_id % 2 + 1)::INT] AS method, '/api/v1/' || event_type AS path, CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS status, count(*) AS requests, round(avg(value), 4) AS mean_ms, max(value) AS most_ms FROM events GROUP BY ALL""")
def request_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(pick(["GET", "POST"], F.col("event_id") % 2).alias("method"), F.concat(F.lit("/api/v1/"), "event_type").alias("path"), F.when(F.col("event_type") == "error", 502).otherwise(200).alias("status"), "value")
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("requests"), F.round(F.avg("value"), 4).alias("mean_ms"), F.max("value").alias("most_ms"))


@query(f"""WITH {_SQL_MACHINE}, started AS (SELECT connection, 'r' || event_id AS request_id, seq FROM msg WHERE event_type = 'signup'),
    done AS (SELECT connection, request_id, min(seq) AS ended, arg_min(detail, (seq, ordinal)) AS status FROM events_out WHERE type = 'complete' GROUP BY connection, request_id),
    failed AS (SELECT connection, request_id, count(*) AS errors FROM events_out WHERE type = 'error' GROUP BY connection, request_id)
    SELECT s.connection, s.request_id, d.status, coalesce(f.errors, 0) AS errors, (d.ended - s.seq) // 1000000 AS elapsed_ms FROM started s LEFT JOIN done d USING (connection, request_id) LEFT JOIN failed f USING (connection, request_id)""")
def lifecycle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    started = m.where(F.get_json_object("payload", "$.type") == "session_start").select("connection", F.get_json_object("payload", "$.request_id").alias("request_id"), "seq")
    key = ["connection", "request_id"]
    events = sessions.machine(m).where("type IN ('complete', 'error')").groupBy(*key).agg(
        F.min(F.when(F.col("type") == "complete", F.col("seq"))).alias("_ended"), F.min_by(F.col("detail"), F.when(F.col("type") == "complete", F.struct("seq", "ordinal"))).alias("status"), F.count(F.when(F.col("type") == "error", 1)).alias("errors")
    )
    return started.join(events, key, "left").select(*key, "status", F.coalesce("errors", F.lit(0)).alias("errors"), F.expr("(_ended - seq) div 1000000").alias("elapsed_ms"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 4 END AS evidence, CASE event_id % 10 WHEN 8 THEN 'timeout' WHEN 9 THEN 'broken' END AS failure, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 <> 0 END AS verified FROM events),
    c AS (SELECT *, CASE WHEN failure = 'timeout' THEN 'RAG_TIMEOUT' WHEN failure IS NOT NULL THEN 'RAG_ERROR' WHEN evidence = 0 THEN 'NO_RELEVANT_CONTEXT' END AS code FROM r)
    SELECT event_id, code, CASE WHEN code IS NULL THEN 'success' ELSE 'failed' END AS status, code IS NULL AND coalesce(verified, false) AS grounded FROM c""")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No evidence, answered (verified, not verified, check timed out) and malfunctions."""
    i = F.col("event_id")
    code, status, grounded = answers.outcome(F.when(i % 6 == 0, 0).otherwise(i % 4), F.when(i % 10 == 8, "timeout").when(i % 10 == 9, "broken"), F.lit(True), F.when(i % 7 != 0, i % 3 != 0))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), status.alias("status"), grounded.alias("grounded"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the reference has no time windows."""
    return streaming.per_window(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT user_id, ts, sum((before IS NULL OR ts >= before + INTERVAL 6 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
    SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS events FROM s GROUP BY user_id, s""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the reference has no time windows."""
    return streaming.per_session(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
