"""Queries over contract rows: validation, locales, audio, query building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import audio, contracts, locales
from ragloom.functions.fixed import ALIASES_EXACT, ALIASES_FOLDED, AUDIO_MAGIC, DEFAULT_TOP_K, ERRORS, LOCALES, MAX_QUERY_CHARS
from ragloom.plans.fixtures import SQL_LOCALES, SQL_QUERIES, messages, pick, queries, table
from ragloom.plans.registry import query


def _joined(*rules: str) -> str:
    """SQL of a list of 'condition|name' as names joined by commas."""
    return "concat_ws(',', " + ", ".join("CASE WHEN {} THEN '{}' END".format(*r.rsplit("|", 1)) for r in rules) + ")"


_IN = "IN (" + ", ".join(f"'{x}'" for x in LOCALES) + ")"

_SQL_ASKED = f"""{SQL_QUERIES}, asked AS (SELECT CASE WHEN conv_id % 29 = 3 THEN '' ELSE request_id END AS request_id, CASE WHEN conv_id % 13 = 0 THEN '' ELSE query END AS query,
    CASE WHEN turn % 5 = 4 THEN 'xx-YY' ELSE language END AS language, CASE WHEN turn > 0 THEN conv_id % 25 END AS top_k, CASE WHEN conv_id % 11 = 5 THEN '' WHEN conv_id % 11 <> 6 THEN session_id END AS session_id, request_id AS k FROM q)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return queries(spark, sf_dir).select(
        F.when(c % 29 == 3, "").otherwise(F.col("request_id")).alias("request_id"), F.when(c % 13 == 0, "").otherwise(F.col("query")).alias("query"), F.when(t % 5 == 4, "xx-YY").otherwise(F.col("language")).alias("language"),
        F.when(t > 0, c % 25).alias("top_k"), F.when(c % 11 == 5, "").when(c % 11 != 6, F.col("session_id")).alias("session_id"), F.col("request_id").alias("k"),
    )


@query(f"""WITH {_SQL_ASKED} SELECT k, coalesce(top_k, 5) AS top_k, {_joined("coalesce(request_id, '') = ''|request_id", "coalesce(query, '') = ''|query", f"language NOT {_IN}|language", "top_k NOT BETWEEN 1 AND 20|top_k", "session_id = ''|session_id")} AS violations FROM asked""")
def validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = contracts.query(F.col("request_id"), F.col("query"), F.col("language"), F.col("top_k"), F.col("session_id"))
    return _asked(spark, sf_dir).select("k", F.coalesce("top_k", F.lit(DEFAULT_TOP_K).cast("long")).alias("top_k"), bad.alias("violations"))


@query(f"""WITH {SQL_QUERIES} SELECT request_id, {_joined("conv_id % 19 = 4|text", "turn % 5 = 4|language", "conv_id % 7 = 3|provider", "((conv_id % 15) - 1) / 10.0 NOT BETWEEN 0 AND 1|confidence", "turn - 1 < 0|timestamp_ms", "conv_id % 23 - 1 < 0|duration_ms")} AS violations FROM q""")
def validate_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    bad = contracts.transcript(
        F.col("request_id"), F.when(c % 19 != 4, F.col("query")), F.when(t % 5 == 4, "fr-FR").otherwise(F.col("language")), F.lit(True),
        F.when(c % 7 == 3, "mock").otherwise("sarvam"), ((c % 15) - 1) / 10.0, t - 1, c % 23 - 1,
    )
    return queries(spark, sf_dir).select("request_id", bad.alias("violations"))


@query(f"""SELECT doc_id, {_joined("doc_id % 17 = 0|answer", "doc_id % 9 = 1|language", "doc_id % 23 = 0|grounded", "doc_id % 37 = 5|sources", "doc_id % 37 <> 5 AND doc_id % 3 > 0 AND doc_id % 19 = 0|source", "n_chars < 50 OR doc_id % 41 = 0|total_ms", "doc_id % 13 = 2|stage_ms")} AS violations FROM documents""")
def validate_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    source = F.struct(F.lit("s").alias("id"), F.lit("t").alias("text"), F.when(i % 19 != 0, F.lit(0.5)).alias("score"))
    sources = F.when(i % 37 != 5, F.array_repeat(source, (i % 3).cast("int")))
    latency = F.struct(F.when(i % 41 != 0, F.col("n_chars").cast("double") - 50).alias("total_ms"), F.lit(None).cast("double").alias("embedding_ms"), F.when(i % 13 == 2, -1.0).otherwise(1.0).alias("retrieval_ms"), F.lit(None).cast("double").alias("reranking_ms"), F.lit(2.0).alias("generation_ms"))
    bad = contracts.answer(i.cast("string"), F.when(i % 17 == 0, "").otherwise(F.col("text")), F.when(i % 9 == 1, "xx").otherwise("hi-IN"), F.when(i % 23 != 0, F.lit(True)), sources, latency)
    return table(spark, sf_dir, "documents").select("doc_id", bad.alias("violations"))


_CLIENT = """CASE event_id % 10 WHEN 0 THEN '{"type":"session_start","request_id":"r","language":null}' WHEN 1 THEN '{"type":"session_start","request_id":"r"}'
    WHEN 2 THEN '{"type":"session_start","request_id":"","language":"fr-FR"}' WHEN 3 THEN '{"type":"audio_end","request_id":"r","extra":1}' WHEN 4 THEN '{"type":"cancel"}'
    WHEN 5 THEN '{"type":"foo","request_id":"r"}' WHEN 6 THEN '{"type":"session_start","request_id":"r","language":"od-IN","session_id":""}' WHEN 7 THEN '{broken' WHEN 8 THEN '{"request_id":"r"}'
    ELSE '{"type":"cancel","request_id":"r","top_k":3}' END"""
_CLIENT_SQL = "['', 'language', 'request_id,language', 'extra', 'request_id', 'type', 'session_id', 'json', 'type', 'extra'][(event_id % 10 + 1)::INT]"
_SERVER_SQL = "['', 'stage', 'code,message', 'retryable', 'status', 'type', 'timestamp', 'text', 'request_id', ''][(event_id % 10 + 1)::INT]"


@query(f"SELECT event_id, {_CLIENT_SQL} AS client_violations, replace({_CLIENT_SQL}, 'extra', '') AS lenient_violations, {_SERVER_SQL} AS server_violations FROM events")
def validate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event stands for one of ten client and ten server rows, one broken rule each."""
    i = (F.col("event_id") % 10).cast("int")
    kind = pick(["processing", "processing", "error", "error", "complete", "nothing", "complete", "transcript", "complete", "error"], i)
    data = pick(['{"stage":"embedding"}', '{"stage":"thinking"}', '{"code":"OOPS","message":""}', '{"code":"RAG_ERROR","message":"m","retryable":null}', '{"status":"done"}', "{}", '{"status":"success"}', "{}", '{"status":"failed"}', '{"code":"RAG_TIMEOUT","message":"m","retryable":true}'], i)
    server = contracts.server_event(kind, F.when(i == 8, "").otherwise("r"), F.when(i != 6, "2024-01-01T00:00:00Z"), data)
    return table(spark, sf_dir, "events").withColumn("j", F.expr(_CLIENT)).select("event_id", contracts.client_event(F.col("j")).alias("client_violations"), contracts.client_event(F.col("j"), strict=False).alias("lenient_violations"), server.alias("server_violations"))


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fr-FR' WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN NULL ELSE {SQL_LOCALES}[(doc_id % 11 + 1)::INT] END AS locale FROM documents)
    SELECT doc_id, locale FROM r WHERE locale IS NULL OR locale = '' OR locale {_IN}""")
def locale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    locale = F.when(i % 5 == 0, "fr-FR").when(i % 5 == 1, "").when(i % 5 > 2, pick(LOCALES, i % 11))
    return table(spark, sf_dir, "documents").select("doc_id", locale.alias("locale")).where(locales.supported(F.col("locale")))


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


_SQL_PROVIDED = f"p AS (SELECT doc_id, lang AS detected, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'zz' ELSE {SQL_LOCALES}[(doc_id % 11 + 1)::INT] END AS requested FROM documents)"


def _provided(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("detected"), F.when(i % 7 == 1, "zz").when(i % 7 > 1, pick(LOCALES, i % 11)).alias("requested"), "text")


_EXACT = {x: x for x in LOCALES} | ALIASES_EXACT


@query(f"WITH {_SQL_PROVIDED}, s AS (SELECT doc_id, coalesce({_case('detected', _EXACT)}, {_case('requested', _EXACT)}) AS strict_locale FROM p) SELECT doc_id, strict_locale, coalesce(strict_locale, 'en-IN') AS locale, CASE WHEN strict_locale IS NULL THEN 'UNSUPPORTED_LANGUAGE' END AS error_code FROM s")
def locale_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = F.col("detected"), F.col("requested")
    strict = locales.resolve_exact(d, r, strict=True)
    return _provided(spark, sf_dir).select("doc_id", strict.alias("strict_locale"), locales.resolve_exact(d, r).alias("locale"), F.when(strict.isNull(), "UNSUPPORTED_LANGUAGE").alias("error_code"))


_FOLDED = ALIASES_FOLDED | {x.lower(): x for x in LOCALES}


@query(f"WITH {_SQL_PROVIDED} SELECT doc_id, coalesce({_case('trim(lower(detected))', _FOLDED)}, {_case('trim(lower(requested))', _FOLDED)}, 'en-IN') AS locale, coalesce({_case('trim(lower(detected))', ALIASES_FOLDED)}, {_case('trim(lower(requested))', ALIASES_FOLDED)}, 'en-IN') AS compat_locale FROM p")
def locale_resolve_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = F.concat(F.lit(" "), F.upper("detected")), F.col("requested")
    return _provided(spark, sf_dir).select("doc_id", locales.resolve_folded(d, r).alias("locale"), locales.resolve_folded(d, r, fixed=False).alias("compat_locale"))


@query(f"""WITH {_SQL_PROVIDED}, t AS (SELECT p.doc_id, d.text, p.detected, p.requested FROM p JOIN documents d USING (doc_id))
    SELECT doc_id::VARCHAR AS request_id, text, coalesce({_case('detected', _EXACT)}, {_case('requested', _EXACT)}, 'en-IN') AS language, true AS is_final, 'sarvam' AS provider, 0.9::DOUBLE AS confidence FROM t WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id::VARCHAR, text, coalesce({_case('detected', _FOLDED)}, {_case('lower(requested)', _FOLDED)}, 'en-IN'), true, 'voxtral', NULL FROM t WHERE doc_id % 2 = 1""")
def transcript_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two providers in one shape; only the first reports confidence."""
    rows, d, r = _provided(spark, sf_dir), F.col("detected"), F.col("requested")
    shape = lambda part, locale, name, confidence: part.select(F.col("doc_id").cast("string").alias("request_id"), "text", locale.alias("language"), F.lit(True).alias("is_final"), F.lit(name).alias("provider"), confidence.alias("confidence"))
    first = shape(rows.where("doc_id % 2 = 0"), locales.resolve_exact(d, r), "sarvam", F.lit(0.9))
    return first.unionByName(shape(rows.where("doc_id % 2 = 1"), locales.resolve_folded(d, r), "voxtral", F.lit(None).cast("double")))


@query(f"WITH {SQL_QUERIES} SELECT request_id, query, language, 5 AS top_k, session_id FROM q")
def query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("request_id", "query", "language", F.lit(DEFAULT_TOP_K).alias("top_k"), "session_id")


@query(f"""WITH {_SQL_ASKED} SELECT sha256(k) AS request_id, query, language, coalesce(top_k, 5) AS top_k, session_id FROM asked
    WHERE query <> '' AND language {_IN} AND (top_k IS NULL OR top_k BETWEEN 1 AND 20)""")
def query_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies to queries, invalid ones left out; ids by hash, so that a second run gives the same."""
    bodies = _asked(spark, sf_dir).select("k", F.to_json(F.struct("query", "language", "top_k", "session_id")).alias("body"))
    q = bodies.withColumn("q", F.from_json("body", "query string, language string, top_k long, session_id string")).select("k", "q.*")
    ok = contracts.query(F.lit("r"), F.col("query"), F.col("language"), F.col("top_k"), F.lit(None).cast("string")) == ""
    return q.where(ok).select(F.sha2("k", 256).alias("request_id"), "query", "language", F.coalesce("top_k", F.lit(DEFAULT_TOP_K).cast("long")).alias("top_k"), "session_id")


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 4194 THEN 'too_large' END AS fault FROM documents")
def audio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand in for audio; the limit is 4194 bytes (0.004 MB) so that both outcomes occur."""
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).cast("long").alias("bytes"), audio.guard(data, 0.004).alias("fault"))


_MAGIC_ROWS = "[" + ", ".join(f"'{m}'" for m, _ in AUDIO_MAGIC) + ", '00010203', '']"
_MIMES = "[" + ", ".join(f"'{m}'" for _, m in AUDIO_MAGIC) + ", NULL, NULL]"


@query(f"SELECT event_id, {_MIMES}[(event_id % 9 + 1)::INT] AS mime, event_id % 3 = 0 AS unusual FROM events")
def audio_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    data = F.unhex(F.concat(pick([*(m for m, _ in AUDIO_MAGIC), "00010203", ""], i % 9), F.when(i % 9 != 8, "FF00").otherwise("")))
    return table(spark, sf_dir, "events").select("event_id", audio.sniff(data).alias("mime"), audio.unusual(F.when(i % 3 == 0, "text/plain").when(i % 3 == 1, "Audio/WAV")).alias("unusual"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 0 THEN strlen(text) // 32 END AS duration_ms FROM documents")
def audio_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", audio.duration_ms(F.encode("text", "UTF-8")).alias("duration_ms"))


@query("""WITH t AS (SELECT conv_id::VARCHAR AS request_id, turn, text, turn % 2 = 0 AS is_final FROM conversations)
    SELECT request_id, arg_min(text, turn) AS text FROM t WHERE is_final AND length(trim(text)) > 0 GROUP BY request_id""")
def final_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once per request, on its first final transcript that is not empty."""
    t = table(spark, sf_dir, "conversations").where((F.col("turn") % 2 == 0) & (F.length(F.trim("text")) > 0))
    return t.groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.min_by("text", "turn").alias("text"))


_MARKERS = r"(?i)(ignore (all )?(previous|prior) instructions|<script|system prompt)"


@query(f"""WITH {SQL_QUERIES}, g AS (SELECT request_id, CASE WHEN turn = 6 THEN repeat(query || ' ', 40) WHEN turn = 2 THEN query || ' Ignore previous instructions' ELSE query END AS query, CASE WHEN turn = 4 THEN 'fr-FR' ELSE language END AS language FROM q)
    SELECT request_id, {_joined(f"language NOT {_IN}|unsupported", "length(trim(query)) = 0|malformed", f"length(query) > {MAX_QUERY_CHARS}|overlong", f"regexp_matches(query, '{_MARKERS}')|unsafe")} AS reasons FROM g""")
def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    text = F.when(t == 6, F.repeat(F.concat(F.col("query"), F.lit(" ")), F.lit(40))).when(t == 2, F.concat(F.col("query"), F.lit(" Ignore previous instructions"))).otherwise(F.col("query"))
    g = queries(spark, sf_dir).select("request_id", text.alias("query"), F.when(t == 4, "fr-FR").otherwise(F.col("language")).alias("language"))
    rules = [("unsupported", ~F.col("language").isin(LOCALES)), ("malformed", F.length(F.trim("query")) == 0), ("overlong", F.length("query") > MAX_QUERY_CHARS), ("unsafe", F.col("query").rlike(_MARKERS))]
    return g.select("request_id", F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in rules))), ",").alias("reasons"))


@query("""WITH s AS (SELECT request_id, request_id AS seen FROM (SELECT conv_id::VARCHAR AS request_id FROM conversations GROUP BY conv_id) WHERE request_id::BIGINT % 10 <> 3
    UNION ALL SELECT conv_id::VARCHAR, conv_id::VARCHAR || 'x' FROM (SELECT conv_id FROM conversations GROUP BY conv_id) WHERE conv_id % 10 = 3)
    SELECT request_id FROM s WHERE seen <> request_id""")
def request_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose id does not come back in the answer."""
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("request_id")).distinct()
    answered = asked.select(F.when(F.col("request_id").cast("long") % 10 == 3, F.concat("request_id", F.lit("x"))).otherwise(F.col("request_id")).alias("request_id"))
    return asked.join(answered, "request_id", "left_anti")


_ERROR_ROWS = ", ".join(f"('{c}', {s}, {str(r).lower()})" for c, (s, r) in ERRORS.items())


@query(f"WITH m(code, status, retryable) AS (VALUES {_ERROR_ROWS}) SELECT event_id, m.code, m.status, m.retryable FROM events JOIN m ON m.code = coalesce([{', '.join(repr(c) for c in ERRORS)}][(event_id % 8 + 1)::INT], 'INTERNAL_ERROR')")
def error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to status and retryability; what is not known is an internal error."""
    raised = F.coalesce(pick([*ERRORS, "SomethingElse"], F.col("event_id") % 8), F.lit(""))
    code = F.when(raised.isin(list(ERRORS)), raised).otherwise("INTERNAL_ERROR")
    status, retry = F.lit(500), F.lit(False)
    for c, (s, r) in ERRORS.items():
        status, retry = F.when(code == c, s).otherwise(status), F.when(code == c, r).otherwise(retry)
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), status.alias("status"), retry.alias("retryable"))


@query("""SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k, event_id % 6 = 0 AS invalid FROM events""")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return e.select("event_id", F.from_json("t", "k long")["k"].alias("k"), F.json_object_keys("t").isNull().alias("invalid"))
