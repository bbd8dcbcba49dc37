"""Exact vector search, floors, two-stage ranking and reranking.

Search scans the corpus once for a block of queries: a task scores its rows
against the block by matrix products and keeps each query's k best, so the
shuffle carries k rows per query and task, whatever the task's size and however
many rows tie. Queries travel with the tasks in blocks of ``QUERY_BLOCK``; after
``ROUND`` blocks the hits are checkpointed, so neither the plan nor the driver
holds more queries than that.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.functions import vectors

QUERY_BLOCK, ROUND = 4096, 16
#: Scores a task holds at once (8 bytes each).
SCORES = 1 << 21
#: Hits whose ids are sent to every executor, so that only their payload moves.
BROADCAST_HITS = 500_000
#: Digits of a score; rounded ones are compared, so that copies tie.
DIGITS = 6


def _unit(vectors: list) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1)
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def _first(q: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best, by score descending, then id; in order of query and rank."""
    by = np.lexsort((item, -score, q))
    q, item, score = q[by], item[by], score[by]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], item[rank < k], score[rank < k]


def _best(batches: Iterable[pd.DataFrame], ids: np.ndarray, unit: np.ndarray, k: int, floor: float | None) -> Iterator[pd.DataFrame]:
    """The k best rows of a task for each query. What is held is 2 k rows a query and ``SCORES`` at most,
    however many rows tie."""
    rows = max(1, SCORES // len(ids))
    q, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, least_id = np.full(len(ids), -np.inf if floor is None else floor), np.full(len(ids), np.iinfo(np.int64).max)
    wait, held = [], 0

    def settle() -> None:
        nonlocal q, item, score, held
        q, item, score = _first(*(np.concatenate(x) for x in zip((q, item, score), *wait, strict=True)), k)
        wait.clear()
        held = 0
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, np.int64)
        full = last[np.diff(np.append(-1, last)) == k]
        least[q[full]], least_id[q[full]] = score[full], item[full]

    for whole in batches:
        every = whole["id"].to_numpy(np.int64)
        for a in range(0, len(whole), rows):
            b, b_ids = whole["vector"].iloc[a : a + rows], every[a : a + rows]
            scores = np.round(unit @ _unit(b.tolist()).T, DIGITS) + 0.0  # no -0.0
            at, c = np.nonzero((scores > least[:, None]) | ((scores == least[:, None]) & (b_ids < least_id[:, None])))
            wait.append((at, b_ids[c], scores[at, c]))
            held += len(at)
            if held > k * len(ids):
                settle()
    if wait:
        settle()
    yield pd.DataFrame({"query_id": ids[q], "item_id": item, "score": score})


def scored(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """queries (query_id, vector), corpus (id, vector): query_id, item_id, score (``DIGITS``), each task's k best.

    Vectors that are null, have a value that is null or not finite, or another dimension than the queries take no part."""
    spark = queries.sparkSession
    sound = lambda df, key: df.select(F.col(key).cast("long").alias(key), "vector").where(F.col(key).isNotNull() & (F.size("vector") > 0) & F.forall("vector", vectors.finite))
    queries, found = sound(queries, "query_id"), sound(corpus, "id")
    sizes = [(r[0], r[1]) for r in queries.groupBy(F.size("vector")).count().collect()]  # a row for each dimension there is
    done, out, taken = [], None, 0
    for dim, count in sizes:
        same, blocks = queries.where(F.size("vector") == dim), -(-count // QUERY_BLOCK)
        for i in range(blocks):
            rows = (same.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else same).collect()
            if not rows:
                continue
            ids, unit = np.array([r[0] for r in rows], np.int64), _unit([r[1] for r in rows])
            part = found.where(F.size("vector") == dim).mapInPandas(lambda b, ids=ids, unit=unit: _best(b, ids, unit, k, floor), "query_id long, item_id long, score double")
            out, taken = part if out is None else out.unionByName(part), taken + 1
            if taken % ROUND == 0 and spark.sparkContext.getCheckpointDir():
                done, out = [*done, out.checkpoint()], None
    if out is not None:
        done.append(out)
    return functools.reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "query_id long, item_id long, score double")


def ranked(scores: DataFrame, k: int, by: str = "score", per: str = "query_id", tie: str = "item_id", name: str = "rank") -> DataFrame:
    """The k best per query, by score descending, then id; Spark limits each group before the shuffle."""
    order = W.partitionBy(per).orderBy(F.col(by).desc(), F.col(tie).asc())
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def topk(queries: DataFrame, corpus: DataFrame, k: int = 5, floor: float | None = None) -> DataFrame:
    """query_id, item_id, score (6 digits), rank. Filters on the corpus belong before the call."""
    return ranked(scored(queries, corpus, k, floor), k)


def above_floor(hits: DataFrame, floor: float) -> DataFrame:
    return hits.where(F.col("score") >= floor)


def rerank(hits: DataFrame, rescored: Column, k: int) -> DataFrame:
    """A permutation of the candidates by another score, cut to k; the first rank stays as fetch_rank."""
    again = hits.withColumnRenamed("rank", "fetch_rank").withColumn("rerank_score", F.round(rescored, 6))
    return ranked(again, k, by="rerank_score")


def rerank_faults(before: DataFrame, after: DataFrame) -> DataFrame:
    """Candidates that a reranker dropped or invented; none if it permutes."""
    keys = ["query_id", "item_id"]
    lost = before.join(after, keys, "left_anti").select(*keys, F.lit("dropped").alias("fault"))
    return lost.unionByName(after.join(before, keys, "left_anti").select(*keys, F.lit("invented").alias("fault")))


def hydrate(hits: DataFrame, payload: DataFrame, most: int | None = None) -> DataFrame:
    """hits with their payload (item_id, ...), null where there is none. most: how many hits there are at most (queries
    times k); up to ``BROADCAST_HITS`` their ids are broadcast, so that no payload but theirs is shuffled."""
    if most is not None and most <= BROADCAST_HITS:
        payload = payload.join(F.broadcast(hits.select("item_id").distinct()), "item_id")
    return hits.join(payload, "item_id", "left")
