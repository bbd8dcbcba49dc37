"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import materialize
from ragloom.llm.skew import meet


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): pairs of ids. One row (id, component) per id that is not the smallest of its component.

    Every step is an aggregation and a join on narrow rows, written out; an id
    with very many edges is joined by broadcast, so no component is ever in one
    task. The number of steps grows with the logarithm of the longest path."""
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_k")).select("a", F.least("a", "m").alias("m"), "_k"), "cc-least")
        large = materialize(meet(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_k")), "cc-low")
        small = meet(large, low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        e = materialize(small, "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
