"""Outcomes, grounding, prompts, fixture answers and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T

GROUNDED_AT = 0.6


def overlap(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct tokens that the context has; 0 without tokens."""
    a = F.array_distinct(T.tokens(answer))
    return F.transform(F.array(a), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, T.tokens(context))) / F.size(x)).otherwise(0.0))[0]


def outcome(evidence: Column, failure: Column, answered: Column, verified: Column) -> tuple[Column, Column, Column]:
    """code, status, grounded. evidence: rows above the floor; failure: null, 'timeout' or another malfunction;
    verified: null if the check did not end in time."""
    broken = failure.isNotNull()
    none = F.coalesce(evidence, F.lit(0)) == 0
    code = F.when(broken, F.when(failure == "timeout", "RAG_TIMEOUT").otherwise("RAG_ERROR")).when(none, "NO_RELEVANT_CONTEXT").when(~answered, "RAG_ERROR")
    return code, F.when(code.isNotNull(), "failed").otherwise("success"), F.when(code.isNull(), F.coalesce(verified, F.lit(False))).otherwise(False)


def sources(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, item_id, text, score) to one row per query with sources in order of rank; at most top_k a query."""
    packed = F.sort_array(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("id"), "text", "score")))
    return hits.groupBy("query_id").agg(F.transform(packed, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), s["score"].alias("score"))).alias("sources"))


def assemble(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """An answer per query, whatever its outcome: queries (query_id, language), hits above the floor."""
    rows = queries.join(sources(hits), "query_id", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    n = F.when(F.col("sources").isNull(), 0).otherwise(n)
    code, status, grounded = outcome(n, F.lit(None).cast("string"), F.lit(True), n > 0)
    latency = F.struct(*(F.lit(None).cast("double").alias(f"{k}_ms") for k in ("total", "embedding", "retrieval", "reranking", "generation")))
    return rows.select(
        "query_id", "language", F.when(n > 0, F.col("sources")[0]["text"]).alias("answer"), grounded.alias("grounded"),
        F.coalesce("sources", F.array().cast("array<struct<id:string,text:string,score:double>>")).alias("sources"), latency.alias("latency"), status.alias("status"), code.alias("error_code"),
    )


def prompt(question: Column, context: Column, language: Column) -> Column:
    """context: array of texts in order of rank."""
    numbered = F.array_join(F.transform(context, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    return F.concat(F.lit("Answer in "), language, F.lit(" and only from the context.\nContext:\n"), numbered, F.lit("\nQuestion: "), question)


def extractive(question: Column, context: Column) -> Column:
    """The context's sentence with most of the question's distinct tokens; of equals the first."""
    q = F.array_distinct(T.tokens(question))
    hits = lambda s: F.size(F.array_intersect(q, T.tokens(s)))
    scored = F.transform(T.sentences(context), lambda s, i: F.struct(hits(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]
