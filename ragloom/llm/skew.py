"""Joining a small row per group to many rows, without a hot group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int, most: int, salt_by: list[str], salts: int = 32) -> DataFrame:
    """Left join of one row a group. groups is broadcast only if it has at most ``most`` rows (a checked count);
    beyond, each of its rows is repeated ``salts`` times and the join's key gets a salt."""
    if n_groups <= most:
        return rows.join(F.broadcast(groups), keys, "left")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def meet(rows: DataFrame, keyed: DataFrame, key: str, hot: int = 100_000) -> DataFrame:
    """Inner join of rows with a row per key, whose ``_k`` says how many rows have that key. Keys of over ``hot`` rows, and of
    over a quarter of a partition's share, are broadcast (at most four a partition); no row of theirs is shuffled."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = keyed.agg(F.sum("_k"), F.max("_k")).first()
    limit = max(hot, (total or 0) // (4 * parts))
    if (most or 0) <= limit:
        return rows.join(keyed.drop("_k"), key)
    large = F.broadcast(keyed.where(F.col("_k") > limit).drop("_k"))
    rest = rows.join(large.select(key), key, "left_anti").join(keyed.where(F.col("_k") <= limit).drop("_k"), key)
    return rows.join(large, key).unionByName(rest)


def even_keys(spark: SparkSession, count: int, parts: int) -> list[int]:
    """count different longs that hash partitioning deals evenly over ``parts`` partitions: count / parts to each."""
    each = -(-count // parts)
    keys: list[list[int]] = [[] for _ in range(parts)]
    first, size = 0, 16 * count + 1000
    while any(len(k) < each for k in keys):
        for i, p in spark.range(first, first + size).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
            if len(keys[p]) < each:
                keys[p].append(i)
        first += size
    return [keys[i % parts][i // parts] for i in range(count)]
