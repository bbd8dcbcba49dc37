"""Intermediate tables in the folder that driver and executors share.

``materialize`` writes a DataFrame as Parquet below ``spark.checkpoint.dir``
and reads it back: lineage is cut, the files outlive any executor, and every
later pass reads only the columns it needs. What is written belongs to the
scope of the running thread; ``begin`` opens a new one and ``release`` deletes
what is in it, so runs beside or after each other keep their tables.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("ragloom-scratch", default=None)


def begin() -> None:
    """A new scope for this thread."""
    _SCOPE.set([])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a folder of our own (local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ragloom/{name}-{uuid.uuid4().hex}"
    if _SCOPE.get() is None:
        begin()
    _SCOPE.get().append(path)
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """batch_rows: rows of an Arrow batch while df is computed, for plans that hand whole texts to Python."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what is in this thread's scope; call only when no DataFrame over it is still to run."""
    jvm, written = spark.sparkContext._jvm, _SCOPE.get() or []
    while written:
        path = jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
