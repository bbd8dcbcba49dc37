"""Vector index: idempotent upserts, snapshots with a manifest written last, verification."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import vectors

POINT = "point_id"


def upsert(points: DataFrame, changes: DataFrame, key: str = POINT, version: str = "version") -> DataFrame:
    """The row of the highest version per key; of equal versions the change wins. max_by aggregates before the shuffle,
    so a key with many versions fills no task, and applying the same changes twice gives the same rows."""
    columns = points.columns
    both = points.withColumn("_new", F.lit(0)).unionByName(changes.select(*columns).withColumn("_new", F.lit(1)))
    row = F.struct(*(F.col(c) for c in columns))
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(version, "_new")).alias("_row")).select("_row.*")


def summary(points: DataFrame, dim: int, vector: str = "vector", key: str = POINT) -> DataFrame:
    """One row: points, distinct keys, points of another dimension or with values that are not finite, mean and extreme norms."""
    bad = vectors.violation(F.col(vector), dim)
    return points.agg(
        F.count("*").alias("points"), F.countDistinct(key).alias("distinct_points"), F.count(F.when(bad == "dimension", 1)).alias("bad_dimension"),
        F.count(F.when(bad == "not_finite", 1)).alias("not_finite"), F.round(F.min(vectors.norm(F.col(vector))), 6).alias("least_norm"), F.round(F.max(vectors.norm(F.col(vector))), 6).alias("most_norm"),
    )


def verify(points: DataFrame, dim: int, expected: int, vector: str = "vector", key: str = POINT) -> DataFrame:
    """summary with ready: all expected points are there once, of the dimension, finite."""
    return summary(points, dim, vector, key).withColumn("ready", (F.col("points") == expected) & (F.col("distinct_points") == F.col("points")) & (F.col("bad_dimension") == 0) & (F.col("not_finite") == 0))


def write_snapshot(points: DataFrame, folder: str, meta: dict) -> None:
    """Points to a folder of their own, then a manifest that names it; a broken write leaves the last manifest in force."""
    spark = points.sparkSession
    version = uuid.uuid4().hex
    points.write.parquet(f"{folder}/points-{version}")
    n = spark.read.parquet(f"{folder}/points-{version}").count()
    row = [(json.dumps(meta | {"points": n, "version": version}, sort_keys=True),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("append").text(f"{folder}/manifests")


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The points and meta of the newest manifest."""
    newest = spark.read.text(f"{folder}/manifests").select("value", F.col("_metadata.file_modification_time").alias("t")).orderBy(F.col("t").desc(), F.col("value").desc()).first()
    meta = json.loads(newest["value"])
    return spark.read.parquet(f"{folder}/points-{meta['version']}"), meta
