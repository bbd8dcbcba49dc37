"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. alpha is
bisected in [0, 1]: first to the largest value whose entropy reaches
``ENTROPY`` of the maximum (1 if the natural shares do), then, if a source
would be repeated more than ``MOST_REPEATS`` times, up to the smallest value
that respects the limit (natural shares at most). Each source gets floor(weight
times the corpus' tokens) tokens.

A budget becomes whole passes over the source and one partial pass. Each pass
is a permutation by a hash of (seed, pass, doc_id), cut into blocks of about
``BLOCK_TOKENS``; the partial pass takes documents in that order while their
running total stays within the budget. Only sums per block cross a window over
a source; running totals inside a block are taken in the one block a source
that its budget ends in. So no task holds a source.

Result: doc_id, source, tokens, epoch, block, order_key (position in the
permutation; sorting by (epoch, order_key) interleaves the sources).

Defined cases: null source is a source of its own; documents without a word
(null and empty texts among them) carry no weight and are left out; rows that
repeat are documents of their own; an empty table gives no row; ties of
order_key go by doc_id, then tokens; a very long document is one draw, with all
its tokens; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.llm.scratch import materialize
from ragloom.llm.skew import attach

ENTROPY, MOST_REPEATS, SEED, STEPS = 0.97, 4.0, 11, 50
BLOCK_TOKENS = 1_000_000
KEY_BITS = 60
#: Sources whose totals the driver bisects over; beyond, each step is an aggregation in Spark.
LOCAL_SOURCES = 100_000
BROADCAST_SOURCES = 50_000


def _sums(totals: DataFrame, n_sources: int) -> Callable[[float], tuple[float, float]]:
    """alpha -> (sum of shares^alpha, sum of shares^alpha * ln(shares^alpha)), shares relative to the largest total."""
    if n_sources <= LOCAL_SOURCES:
        top = [r[0] for r in totals.select("n").orderBy("n").collect()]
        logs = [math.log(x / top[-1]) for x in top]
        return lambda a: (math.fsum(math.exp(a * x) for x in logs), math.fsum(math.exp(a * x) * a * x for x in logs))
    most = totals.agg(F.max("n")).first()[0]
    log = F.log(F.col("n") / F.lit(most))
    return lambda a: tuple(totals.agg(F.sum(F.exp(log * a)), F.sum(F.exp(log * a) * log * a)).first())


def exponent(totals: DataFrame, n_sources: int, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """totals: source, n. Entropy falls and the largest repetition (of the smallest source) falls as alpha grows."""
    if n_sources < 2:
        return 1.0
    sums = _sums(totals, n_sources)
    least, most, whole = totals.agg(F.min("n"), F.max("n"), F.sum("n")).first()

    def enough(a: float) -> bool:
        s, t = sums(a)
        return math.log(s) - t / s >= entropy * math.log(n_sources)

    def gentle(a: float) -> bool:
        return math.pow(least / most, a) / sums(a)[0] * whole <= most_repeats * least

    alpha = 1.0
    if not enough(1.0):
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if enough(mid) else (lo, mid)
        alpha = lo
    if not gentle(alpha):
        lo, hi = alpha, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if gentle(mid) else (mid, hi)
        alpha = hi
    return alpha


def budgets(totals: DataFrame, n_sources: int, alpha: float) -> DataFrame:
    """totals with budget, full (whole passes) and rest (tokens of the partial pass)."""
    most, whole = totals.agg(F.max("n"), F.sum("n")).first()
    part = F.pow(F.col("n") / F.lit(most), F.lit(alpha))
    summed = totals.agg(F.sum(part)).first()[0]
    out = totals.withColumn("budget", F.floor(part / F.lit(summed) * F.lit(whole) + 1e-6).cast("long"))
    return out.withColumn("full", F.floor(F.col("budget") / F.col("n")).cast("int")).withColumn("rest", F.col("budget") - F.col("full") * F.col("n"))


def _order_key(epoch: Column, seed: int) -> Column:
    """60 bits of MD5, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    tokens = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), tokens.alias("tokens")), "mix-tokens").where("tokens > 0")
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    totals = materialize(rows.groupBy("_s").agg(F.sum("tokens").alias("n")), "mix-totals")
    n_sources = totals.count()
    if not n_sources:
        return rows.select("doc_id", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("order_key"))
    shares = materialize(budgets(totals, n_sources, exponent(totals, n_sources, entropy, most_repeats)), "mix-budgets")
    dealt = attach(rows, shares, ["_s"], n_sources, BROADCAST_SOURCES, ["doc_id", "tokens"])
    dealt = dealt.withColumn("_blocks", F.ceil(F.col("n") / block_tokens).cast("double"))
    block = lambda d: d.withColumn("block", F.floor(F.col("order_key") / F.lit(float(1 << KEY_BITS)) * F.col("_blocks")).cast("long"))
    whole = block(dealt.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("order_key", _order_key(F.col("epoch"), seed)))
    partial = block(dealt.withColumn("epoch", F.col("full")).withColumn("order_key", _order_key(F.col("full"), seed)))

    per_block = partial.groupBy("_s", "block", "rest").agg(F.sum("tokens").alias("_t"))
    upto = W.partitionBy("_s").orderBy("block")
    ends = per_block.withColumn("_c", F.sum("_t").over(upto)).where(F.col("_c") > F.col("rest")).groupBy("_s").agg(F.min(F.struct("block", (F.col("_c") - F.col("_t")).alias("before"))).alias("_end"))
    ends = materialize(ends.select("_s", F.col("_end.block").alias("_last"), F.col("_end.before").alias("_before")), "mix-ends")
    cut = attach(partial, ends, ["_s"], n_sources, BROADCAST_SOURCES, ["doc_id", "tokens"])
    inner = cut.where(F.col("block") < F.col("_last"))
    running = W.partitionBy("_s", "block").orderBy("order_key", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = cut.where(F.col("block") == F.col("_last")).withColumn("_r", F.sum("tokens").over(running)).where(F.col("_before") + F.col("_r") <= F.col("rest"))
    out = ["doc_id", "source", "tokens", "epoch", "block", "order_key"]
    return whole.select(out).unionByName(inner.select(out)).unionByName(edge.select(out))
