"""documents -> quality rules -> line dedup -> near duplicates -> decontamination -> mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of docs. A stage first deletes the intermediate tables of
the stage before it in this thread, whose result is written by then. Null and empty texts,
repeated rows, empty tables and further columns are treated as the operators'
own descriptions say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ragloom import let_workers_import
from ragloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    let_workers_import(spark)
    scratch.begin()
    return quality.keep_good(docs)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, n_chars follows."""
    scratch.release(spark)
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    scratch.release(spark)
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    scratch.release(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which documents are drawn, source by source to its budget."""
    scratch.release(spark)
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", boilerplate_lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark_leaks), ("mixing", mixture)]

#: The stages' estimates, links and retrieval are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
