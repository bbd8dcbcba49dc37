"""Derived inputs, once as DataFrames and once as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.fixed import LOCALES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at):
    """The value at an index, 0-based."""
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


SQL_LOCALES = "[" + ", ".join(f"'{x}'" for x in LOCALES) + "]"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "conv_id", "turn", F.col("text").alias("query"), pick(LOCALES, F.col("conv_id") % 11).alias("language"), F.col("conv_id").cast("string").alias("session_id"))


SQL_QUERIES = f"""q AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, text AS query, {SQL_LOCALES}[(conv_id % 11 + 1)::INT] AS language, conv_id::VARCHAR AS session_id
    FROM conversations WHERE role = 'user')"""

#: Queries of a search are all rows whose id is divisible by this; they search all rows, their own included.
QUERY_EVERY = 100
_IS_QUERY = f"vec_id % {QUERY_EVERY} = 0"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(_IS_QUERY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


SQL_SCORES = f"""scores AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, q.label AS query_label, c.label AS label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.{_IS_QUERY})"""


def sql_top(k: int, where: str = "true", source: str = "scores", by: str = "score", name: str = "rank") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, item_id)::INT AS {name} FROM {source} WHERE {where}) WHERE {name} <= {k})"


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant to a query are the rows of its label among the hundred ids that begin with its own."""
    q, c = vector_queries(spark, sf_dir), corpus(spark, sf_dir).withColumn("_q", F.floor(F.col("id") / QUERY_EVERY) * QUERY_EVERY)
    return q.join(c, (q["query_id"] == c["_q"]) & (q["query_label"] == c["label"])).select("query_id", F.col("id").alias("item_id"))


SQL_JUDGED = f"judged AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id = c.vec_id // {QUERY_EVERY} * {QUERY_EVERY} WHERE q.{_IS_QUERY})"


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("ts"), v.alias("total_ms"), F.round(v * 0.1, 4).alias("embedding_ms"), F.round(v * 0.2, 4).alias("retrieval_ms"),
        F.when(F.col("event_id") % 4 != 0, F.round(v * 0.1, 4)).alias("reranking_ms"), F.round(v * 0.5, 4).alias("generation_ms"),
    )


SQL_LATENCIES = """lat AS (SELECT event_id, user_id, event_type, ts, value AS total_ms, round(value * 0.1, 4) AS embedding_ms, round(value * 0.2, 4) AS retrieval_ms,
    CASE WHEN event_id % 4 <> 0 THEN round(value * 0.1, 4) END AS reranking_ms, round(value * 0.5, 4) AS generation_ms FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection per user: signup starts, view and click are frames, purchase ends, error cancels."""
    e = table(spark, sf_dir, "events")
    kind, i, u = F.col("event_type"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    json = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    locale = F.when(F.col("event_id") % 9 == 0, "fr-FR").otherwise(pick(LOCALES, F.col("event_id") % 11))
    payload = (
        F.when(kind == "signup", json('{"type":"session_start","request_id":"r', i, '","language":"', locale, '","session_id":"s', u, '"}'))
        .when((kind == "purchase") & (F.col("event_id") % 7 == 0), json('{"type":"audio_end","request_id":"other"}'))
        .when(kind == "purchase", F.lit('{"type":"audio_end"}'))
        .when((kind == "error") & (F.col("event_id") % 5 == 0), F.lit("{broken"))
        .when((kind == "error") & (F.col("event_id") % 2 == 0), json('{"type":"cancel","request_id":"c', i, '"}'))
        .when(kind == "error", F.lit('{"type":"cancel"}'))
    )
    binary = kind.isin("view", "click")
    return e.select(u.alias("connection"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"), F.when(binary, "binary").otherwise("text").alias("kind"), F.when(binary, F.floor(F.col("value") * 100)).cast("long").alias("bytes"), payload.alias("payload"))


SQL_MESSAGES = f"""msg AS (SELECT user_id::VARCHAR AS connection, epoch_us(ts) * 1000 + event_id % 1000 AS seq, event_id, event_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'binary' ELSE 'text' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN floor(value * 100)::BIGINT END AS bytes,
    CASE WHEN event_id % 9 = 0 THEN 'fr-FR' ELSE {SQL_LOCALES}[(event_id % 11 + 1)::INT] END AS locale FROM events)"""
