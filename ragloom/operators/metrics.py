"""Retrieval quality, grounding and latency metrics. Rankings are (query_id, item_id, rank), judgements (query_id, item_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERCENTILES = {"p50": 0.5, "p70": 0.7, "p95": 0.95, "p100": 1.0}


def per_query(ranking: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, relevant, hits, first_rank, recall, rr, ndcg for each query with a judgement."""
    total = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hit = ranking.where(F.col("rank") <= k).join(judged, ["query_id", "item_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return total.join(hit, "query_id", "left").select(
        "query_id", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"), "first_rank",
        F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def mean(scores: DataFrame, *by: str) -> DataFrame:
    """Means over queries, apart for each value of by: never averaged over directions."""
    return scores.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall", "rr", "ndcg")))


#: Cells between a group's least and greatest value by which its percentiles are sought.
CELLS = 4096
#: Groups whose ends and wanted cells (two rows a share and group at most) are broadcast; beyond, they are joined.
BROADCAST_GROUPS = 50_000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """by, requests, least and greatest value (_least, _most), and for each name in shares the exact percentile with linear
    interpolation. First values are counted in ``CELLS`` cells a group, then only those of the cells that hold a
    wanted rank are counted one by one, so no group's values are in one task. Nulls are not counted."""
    given = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = given.groupBy(*by).agg(F.count("*").alias("requests"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = ends.count() <= BROADCAST_GROUPS
    beside = lambda rows, groups, keys: rows.join(F.broadcast(groups) if few else groups, keys)
    width = F.col("_most") - F.col("_least")
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_least")) / width * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")
    placed = beside(given, ends, by).select(*by, "_v", "requests", cell.alias("_cell"))
    at = {name: (F.col("requests") - 1) * F.lit(share) for name, share in shares.items()}
    ranks = F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)))
    running = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = placed.groupBy(*by, "requests", "_cell").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(running))
    wanted = cells.where(F.exists(ranks, lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))).select(*by, "_cell", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = beside(placed, wanted, [*by, "_cell"]).groupBy(*by, "requests", "_cell", "_before", "_v").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(order))
    value_at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")), F.col("_v")))
    found = ranked.groupBy(*by, "requests").agg(*(value_at(f(x).cast("long")).alias(f"_{name}_{f.__name__}") for name, x in at.items() for f in (F.floor, F.ceil)))
    low, high = (lambda name, f=f: F.col(f"_{name}_{f}") for f in ("floor", "ceil"))
    done = found.select(*by, *(F.round(low(name) + (x - F.floor(x)) * (high(name) - low(name)), digits).alias(name) for name, x in at.items()))
    return ends.join(done, by)


def prf(predicted: Column, truth: Column) -> list[Column]:
    tp, fp, fn = (F.count(F.when(c, 1)) for c in (predicted & truth, predicted & ~truth, ~predicted & truth))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows a second; null without time."""
    return F.round(F.try_divide(rows.cast("double"), seconds.cast("double")), 6)
