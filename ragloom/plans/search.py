"""Queries over vectors: search, floors, reranking, answers, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import vectors
from ragloom.functions.fixed import DEFAULT_TOP_K, FETCH_K
from ragloom.operators import answers, metrics, retrieval
from ragloom.plans.fixtures import SQL_JUDGED, SQL_SCORES, corpus, judgements, sql_top, table, vector_queries
from ragloom.plans.registry import query

FLOOR = 0.35
# The fixture reranker: 0.7 cosine + 0.3 of a stand-in for token overlap, which vectors do not have: nearness of labels.
RERANK = "round(0.7 * score + 0.3 / (1 + abs(query_label - label)), 6)"


def _hits(spark: SparkSession, sf_dir: str, k: int = DEFAULT_TOP_K, floor: float | None = None) -> DataFrame:
    return retrieval.topk(vector_queries(spark, sf_dir).select("query_id", "vector"), corpus(spark, sf_dir).select("id", "vector"), k, floor)


def _most(spark: SparkSession, sf_dir: str, k: int) -> int:
    return k * vector_queries(spark, sf_dir).count()


def _labelled(spark: SparkSession, sf_dir: str, hits: DataFrame, k: int) -> DataFrame:
    q = vector_queries(spark, sf_dir).select("query_id", "query_label")
    return retrieval.hydrate(hits, corpus(spark, sf_dir).select(F.col("id").alias("item_id"), "label"), _most(spark, sf_dir, k)).join(q, "query_id")


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _labelled(spark, sf_dir, _hits(spark, sf_dir, FETCH_K), FETCH_K)
    return retrieval.rerank(hits, 0.7 * F.col("score") + 0.3 / (1 + F.abs(F.col("query_label") - F.col("label"))), DEFAULT_TOP_K)


@query(f"WITH {SQL_SCORES} SELECT query_id, item_id, score, rank FROM {sql_top(5)}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)
    SELECT vec_id AS item_id, label, round(list_cosine_similarity(embedding::DOUBLE[], first::DOUBLE[]), 6) AS score FROM embeddings JOIN f USING (label)""")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row against its label's first."""
    rows = corpus(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min_by("vector", "id").alias("first"))
    return rows.join(first, "label").select(F.col("id").alias("item_id"), "label", F.round(vectors.cosine(F.col("vector"), F.col("first")), 6).alias("score"))


@query(f"WITH {SQL_SCORES}, f AS {sql_top(FETCH_K)} SELECT query_id, item_id, score, rank FROM f WHERE rank <= 5")
def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, FETCH_K).where(F.col("rank") <= DEFAULT_TOP_K)


@query(f"WITH {SQL_SCORES} SELECT query_id, item_id, score, rank FROM {sql_top(5, where='label < 5')}")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus(spark, sf_dir).where(F.col("label") < 5).select("id", "vector")
    return retrieval.topk(vector_queries(spark, sf_dir).select("query_id", "vector"), kept, DEFAULT_TOP_K)


@query(f"WITH {SQL_SCORES} SELECT query_id, item_id, score, rank FROM {sql_top(5)} WHERE score >= {FLOOR}")
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, floor=FLOOR)


_SQL_RERANKED = f"{SQL_SCORES}, f AS {sql_top(FETCH_K)}, g AS (SELECT * EXCLUDE (rank), rank AS fetch_rank, {RERANK} AS rerank_score FROM f), reranked AS {sql_top(5, source='g', by='rerank_score')}"


@query(f"WITH {_SQL_RERANKED} SELECT query_id, item_id, score, fetch_rank, rerank_score, rank FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "item_id", "score", "fetch_rank", "rerank_score", "rank")


@query(f"""WITH {SQL_SCORES}, f AS {sql_top(FETCH_K)}, a AS (SELECT query_id, item_id + (item_id % 17 = 0)::INT * 1000000 AS item_id FROM f)
    SELECT f.query_id, f.item_id, 'dropped' AS fault FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = f.query_id AND a.item_id = f.item_id)
    UNION ALL SELECT a.query_id, a.item_id, 'invented' FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE a.query_id = f.query_id AND a.item_id = f.item_id)""")
def rerank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker that renames some candidates is found out."""
    before = _hits(spark, sf_dir, FETCH_K).select("query_id", "item_id")
    after = before.withColumn("item_id", F.col("item_id") + F.when(F.col("item_id") % 17 == 0, 1_000_000).otherwise(0))
    return retrieval.rerank_faults(before, after)


@query(f"WITH {SQL_SCORES} SELECT query_id, item_id, score, rank, label FROM {sql_top(5)}")
def hydrate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hydrate(_hits(spark, sf_dir), corpus(spark, sf_dir).select(F.col("id").alias("item_id"), "label"), _most(spark, sf_dir, DEFAULT_TOP_K)).select("query_id", "item_id", "score", "rank", "label")


@query(f"""WITH {SQL_SCORES}, t AS (SELECT * FROM {sql_top(5)} WHERE score >= {FLOOR}),
    s AS (SELECT query_id, count(*) AS n, string_agg(item_id || ':' || printf('%.6f', score), ',' ORDER BY rank) AS sources, 'vector ' || arg_min(item_id, rank) AS answer FROM t GROUP BY query_id)
    SELECT q.vec_id AS query_id, 'en-IN' AS language, answer, n IS NOT NULL AS grounded, coalesce(sources, '') AS sources, NULL::DOUBLE AS total_ms,
    CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN n IS NULL THEN 'NO_RELEVANT_CONTEXT' END AS error_code FROM embeddings q LEFT JOIN s ON s.query_id = q.vec_id WHERE q.vec_id % 100 = 0""")
def answer_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per query whatever its outcome; sources shown as id:score in order of rank."""
    hits = _hits(spark, sf_dir, floor=FLOOR).withColumn("text", F.concat(F.lit("vector "), F.col("item_id").cast("string")))
    out = answers.assemble(vector_queries(spark, sf_dir).select("query_id", F.lit("en-IN").alias("language")), hits)
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["id"], F.lit(":"), F.format_string("%.6f", s["score"]))), ",")
    return out.select("query_id", "language", "answer", "grounded", shown.alias("sources"), F.col("latency.total_ms").alias("total_ms"), "status", "error_code")


_K = 20
_SQL_PER = f"""{SQL_SCORES}, {SQL_JUDGED}, ranking AS {sql_top(FETCH_K)},
    total AS (SELECT query_id, count(*) AS relevant FROM judged GROUP BY query_id),
    hit AS (SELECT query_id, count(*) AS hits, min(rank) AS first_rank, sum(1 / log2(rank + 1)) AS dcg FROM ranking JOIN judged USING (query_id, item_id) WHERE rank <= {_K} GROUP BY query_id),
    per AS (SELECT query_id, relevant, coalesce(hits, 0) AS hits, first_rank, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(1 / first_rank, 0), 6) AS rr,
        round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least({_K}, relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM total LEFT JOIN hit USING (query_id))"""


def _per(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_query(_hits(spark, sf_dir, FETCH_K), judgements(spark, sf_dir), _K)


@query(f"WITH {_SQL_PER} SELECT query_id, relevant, hits, first_rank::INT AS first_rank, recall, rr, ndcg FROM per")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per(spark, sf_dir).withColumn("first_rank", F.col("first_rank").cast("int"))


@query(f"WITH {_SQL_PER} SELECT count(*) AS queries, round(avg(recall), 6) AS mean_recall FROM per")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean(_per(spark, sf_dir)).select("queries", "mean_recall")


@query(f"WITH {_SQL_PER} SELECT count(*) AS queries, round(avg(rr), 6) AS mean_rr FROM per")
def mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean(_per(spark, sf_dir)).select("queries", "mean_rr")


@query(f"WITH {_SQL_PER} SELECT count(*) AS queries, round(avg(ndcg), 6) AS mean_ndcg FROM per")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean(_per(spark, sf_dir)).select("queries", "mean_ndcg")


_SQL_DIRECTED = f"""{SQL_SCORES}, {SQL_JUDGED}, ranking AS {sql_top(FETCH_K)},
    j AS (SELECT *, CASE WHEN query_id % 2 = item_id % 2 THEN 'mono' ELSE 'cross' END AS direction FROM judged),
    per AS (SELECT j.query_id, j.direction, count(*) AS relevant, count(r.rank) AS hits, round(count(r.rank) / count(*), 6) AS recall FROM j LEFT JOIN ranking r ON r.query_id = j.query_id AND r.item_id = j.item_id GROUP BY j.query_id, j.direction)"""


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judgements(spark, sf_dir).withColumn("direction", F.when(F.col("query_id") % 2 == F.col("item_id") % 2, "mono").otherwise("cross"))
    found = judged.join(_hits(spark, sf_dir, FETCH_K).select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    return found.groupBy("query_id", "direction").agg(F.count("*").alias("relevant"), F.count("rank").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("relevant"), 6))


@query(f"WITH {_SQL_DIRECTED} SELECT direction, count(*) AS queries, round(avg(recall), 6) AS mean_recall FROM per GROUP BY direction")
def direction_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directed(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("mean_recall"))


@query(f"""WITH {_SQL_DIRECTED}, l AS (SELECT ['en-IN', 'hi-IN', 'bn-IN', 'ta-IN'][(query_id // 100 % 4 + 1)::INT] AS locale, direction, round(avg(recall), 6) AS mean_recall FROM per GROUP BY ALL)
    SELECT direction, arg_min(locale, (mean_recall, locale)) AS worst_locale, min(mean_recall) AS mean_recall FROM l GROUP BY direction""")
def worst_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    locale = F.get(F.array(*map(F.lit, ["en-IN", "hi-IN", "bn-IN", "ta-IN"])), (F.floor(F.col("query_id") / 100) % 4).cast("int"))
    per = _directed(spark, sf_dir).groupBy(locale.alias("locale"), "direction").agg(F.round(F.avg("recall"), 6).alias("mean_recall"))
    return per.groupBy("direction").agg(F.min_by("locale", F.struct("mean_recall", "locale")).alias("worst_locale"), F.min("mean_recall").alias("mean_recall"))


@query(f"""WITH {_SQL_RERANKED}, {SQL_JUDGED}, base AS (SELECT * FROM f WHERE rank <= 5),
    b AS (SELECT base.query_id, count(j.item_id) AS hits FROM base LEFT JOIN judged j ON j.query_id = base.query_id AND j.item_id = base.item_id GROUP BY base.query_id),
    a AS (SELECT r.query_id, count(j.item_id) AS hits FROM reranked r LEFT JOIN judged j ON j.query_id = r.query_id AND j.item_id = r.item_id GROUP BY r.query_id)
    SELECT query_id, b.hits AS hits_without, a.hits AS hits_with, a.hits - b.hits AS delta FROM a JOIN b USING (query_id)""")
def rerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judgements(spark, sf_dir).withColumn("_hit", F.lit(1))
    hits = lambda r, name: r.select("query_id", "item_id").join(judged, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count("_hit").alias(name))
    both = hits(_hits(spark, sf_dir), "hits_without").join(hits(_reranked(spark, sf_dir), "hits_with"), "query_id")
    return both.withColumn("delta", F.col("hits_with") - F.col("hits_without"))


_MODELS = "(VALUES ('a', 0.61, 140.0, 384), ('b', 0.72, 180.0, 768), ('c', 0.72, 180.0, 384), ('d', 0.90, 260.0, 1024), ('e', 0.55, 60.0, 256)) AS m(model, xl_recall, p95_ms, dim)"


@query(f"SELECT model, xl_recall::DOUBLE AS xl_recall, p95_ms::DOUBLE AS p95_ms, dim FROM {_MODELS} WHERE p95_ms < 200 ORDER BY xl_recall DESC, p95_ms, dim LIMIT 1")
def model_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, rank, tie-break over candidate embedders (a literal table)."""
    m = spark.sql(f"SELECT model, CAST(xl_recall AS DOUBLE) AS xl_recall, CAST(p95_ms AS DOUBLE) AS p95_ms, dim FROM {_MODELS}")
    return m.where("p95_ms < 200").orderBy(F.col("xl_recall").desc(), "p95_ms", "dim").limit(1)


@query(f"""WITH e AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 1), s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, e c WHERE q.vec_id % 100 = 0) SELECT query_id, item_id, score, rank FROM {sql_top(5, source='s')}""")
def topk_unsound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows spoilt by an infinite, a null or a missing value are never among the best."""
    v, i = F.col("vector"), F.col("id")
    spoilt = F.when(i % 15 == 1, F.transform(v, lambda x: F.lit(float("inf")).cast("float"))).when(i % 15 == 6, F.transform(v, lambda x, at: F.when(at > 0, x))).otherwise(F.slice(v, 1, 63))
    rows = corpus(spark, sf_dir).withColumn("vector", F.when(i % 5 == 1, spoilt).otherwise(v))
    return retrieval.topk(vector_queries(spark, sf_dir).select("query_id", "vector"), rows.select("id", "vector"))


_BAD = "CASE WHEN vec_id % 50 = 0 THEN 'dimension' WHEN vec_id % 50 = 1 THEN 'not_finite' ELSE '' END"


@query(f"SELECT vec_id, {_BAD} AS fault FROM embeddings")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = F.col("embedding"), F.col("vec_id") % 50
    spoilt = F.when(i == 0, F.slice(v, 1, 63)).when(i == 1, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(vectors.violation(spoilt, 64), F.lit("")).alias("fault"))
