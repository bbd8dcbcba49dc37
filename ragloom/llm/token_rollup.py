"""Token counts as delta-maintained rollups.

A store is a folder of committed batches. A batch is a table of signed rows
(sign +1 insert, -1 delete, other numbers that many of them; a revised count is
a delete of the old and an insert of the new count), summed per (source, lang,
tokenizer) before it is written, so a batch is as small as its groups.

A writer publishes a folder of its own, ``batches/<id>.<random>``, by one rename.
Readers count one folder of each id, the first by name, so a batch may be sent
any number of times, by writers at the same time too, and needs no lock.
``compact`` takes one listing, writes the sums of what is live in it and the ids
they stand for as one folder, and then deletes the sums it replaced. What is
committed meanwhile is not in the listing and stays live. A compaction holds
only the ids it replaced itself, an older compaction among them; ids are looked
up as a table and never sent to the driver. A store has one compactor at a time.

Defined cases: null text has 0 tokens and still counts as a document; null
source or language is a group of its own; rows that repeat count each time; of
rows with equal texts the one with the smallest doc_id (then source, language)
is kept; an empty batch commits (and is then known); totals of 0 are left out; a
very long text is counted whole; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.scratch import materialize

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def vocabulary(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 of the token, a space, its rank. Read on the driver and sent along (under 1 MB)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Fixed value: the pre-tokenisation pattern that these vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(ranks: dict[bytes, int]) -> Callable[[str], int]:
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        return len(encoding.encode_ordinary(text)) if isinstance(text, str) and text else 0

    return count


def count_tokens(docs: DataFrame, ranks: dict[str, dict[bytes, int]], text: str = "text") -> DataFrame:
    """docs without its text but with a column of counts for each name in ranks."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema
    for name in ranks:
        schema = schema.add(name, "long")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {name: counter(r) for name, r in ranks.items()}
        for b in batches:
            yield b[rest].assign(**{name: [count(t) for t in b[text]] for name, count in counts.items()})

    return docs.select(*rest, text).mapInPandas(run, schema)


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Names of the published folders, each an id, a dot and the writer's own part."""
        fs, p = self._fs(f"{self.path}/batches")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _replaced(self, names: list[str]) -> DataFrame:
        """id: what compactions among names stand for."""
        folders = [f"{self.path}/batches/{n}/ids" for n in names if n.startswith("compact-")]
        return self.spark.read.schema("id string").parquet(*folders) if folders else self.spark.createDataFrame([], "id string")

    def live(self, names: list[str] | None = None) -> list[str]:
        """One folder for each id that no compaction stands for."""
        names = self.batches() if names is None else names
        first: dict[str, str] = {}
        for n in names:
            first.setdefault(n.rpartition(".")[0], n)
        if not any(n.startswith("compact-") for n in names):
            return list(first.values())
        known = self.spark.createDataFrame(list(first.items()), "id string, name string")
        return sorted(r["name"] for r in known.join(self._replaced(names), "id", "left_anti").collect())

    def committed(self, batch: str) -> bool:
        name, names = quote(batch, safe=""), self.batches()
        return any(n.rpartition(".")[0] == name for n in names) or not self._replaced(names).where(F.col("id") == name).isEmpty()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: source, lang, tokenizer, sign, n_tokens. False if the batch was committed before."""
        if batch.startswith("compact-"):
            raise ValueError("names of compactions are not for batches")
        if self.committed(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
        self._publish(quote(batch, safe=""), summed, None)
        return True

    def _publish(self, name: str, summed: DataFrame, ids: DataFrame | None) -> None:
        own = f"{name}.{uuid.uuid4().hex}"
        staged, final = f"{self.path}/staging/{own}", f"{self.path}/batches/{own}"
        summed.write.parquet(f"{staged}/sums")
        if ids is not None:
            ids.write.parquet(f"{staged}/ids")
        fs, p = self._fs(final)
        fs.mkdirs(p.getParent())
        if not fs.rename(self._fs(staged)[1], p):
            raise OSError(f"could not commit {name}")

    def _sums(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/batches/{n}/sums" for n in names)) if names else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        return self._sums(self.live()).where("docs != 0 or tokens != 0")

    def compact(self, name: str) -> None:
        """One folder instead of all that are live now; their ids stay known."""
        old = self.live()
        if not old:
            return
        ids = self.spark.createDataFrame([(n.rpartition(".")[0],) for n in old], "id string").coalesce(1)
        self._publish(f"compact-{quote(name, safe='')}", self._sums(old), ids)
        for n in old:
            fs, p = self._fs(f"{self.path}/batches/{n}" + ("/sums" if n.startswith("compact-") else ""))
            fs.delete(p, True)


def maintain(docs: DataFrame, store: Rollup, old: str, new: str, vocabularies: str) -> DataFrame:
    """Totals after four batches: all rows under tokenizer ``old``; deletes of all but one row of equal texts; counts of
    rows not in English revised to ``new``; and the first batch again, which changes nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), F.col("text")).alias("g"), "text")
    ranks = {name: vocabulary(f"{vocabularies.rstrip('/')}/{name}.tiktoken") for name in (old, new)}
    counts = materialize(count_tokens(rows.withColumn("doc_id", F.col("doc_id").cast("string")), ranks), "rollup-counts")
    counts = counts.withColumn("doc_id", F.col("doc_id").cast("long"))
    of = lambda df, name, sign: df.select("source", "lang", F.lit(name).alias("tokenizer"), sign.alias("sign"), F.col(name).alias("n_tokens"))
    one = F.lit(1)
    alike = counts.groupBy("h", "g", "source", "lang", old, new).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    texts = alike.groupBy("h", "g").agg(F.min(F.struct("doc_id", "source", "lang", old, new)).alias("kept"), F.sum("n").alias("all"))
    texts = materialize(texts.select("h", "g", "all", "kept.source", "kept.lang", f"kept.{old}", f"kept.{new}"), "rollup-texts")
    foreign = texts.where(~F.col("lang").eqNullSafe("en"))
    copied = texts.where(F.col("all") > 1).select("h", "g", F.col("source").alias("_source"), F.col("lang").alias("_lang"))
    stays = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))
    dropped = alike.join(copied, ["h", "g"]).withColumn("gone", F.col("n") - stays.cast("long")).where("gone > 0")
    store.commit("load", of(counts, old, one))
    store.commit("drop-copies", of(dropped, old, -F.col("gone")))
    store.commit("recount", of(foreign, old, -one).unionByName(of(foreign, new, one)))
    store.commit("load", of(counts, old, one))
    return store.totals()
