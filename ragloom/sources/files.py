"""Audio uploads in, deterministic JSON lines out."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import audio


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, mime, fault of each file; the guard looks at length before content is needed."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").alias("audio"), audio.sniff(F.col("content")).alias("mime"), audio.guard(F.col("content")).alias("fault"), audio.duration_ms(F.col("content")).alias("duration_ms"))


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Rows in order of key, null fields left out. Parts are ranges of key, so their concatenation is ordered and the
    same for the same rows and number of partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def jsonl_hash(path: str) -> str:
    """SHA-256 over the parts in order (local folders, for tests)."""
    h = hashlib.sha256()
    for p in sorted(Path(path).glob("part-*")):
        for line in p.read_text().splitlines():
            json.loads(line)
            h.update(line.encode() + b"\n")
    return h.hexdigest()
