"""Corpus scan, nested validation, duplicates, hold-out exclusion, profile and manifest of a split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

try:
    import ahocorasick
except ImportError:  # then a broadcast join does the same, text by text
    ahocorasick = None

#: Held-out texts (by count and by total characters) that are sent to every executor at once; beyond, blocks of them.
HELDOUT_ROWS, HELDOUT_CHARS = 20_000, 2_000_000


def exploded(nested: DataFrame, array: str) -> DataFrame:
    """Rows of an array of structs with their position; arrays that are null or empty give none."""
    keep = [c for c in nested.columns if c != array]
    return nested.select(*keep, F.posexplode(array).alias("position", "_item")).select(*keep, "position", "_item.*")


def mismatched(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose parallel arrays differ in length, nulls included."""
    return df.where(~F.size(a).eqNullSafe(F.size(b)) | F.col(a).isNull() | F.col(b).isNull())


def duplicate_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per text that several records have; only hashes are shuffled."""
    return docs.select(F.sha2(text, 256).alias("text_hash"), key).groupBy("text_hash").agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The record with the smallest key of each text; records without a key stay. Texts are hashed where they are read;
    only the keys of later copies meet the records, so the planner can broadcast them."""
    hashed = docs.select(F.sha2(text, 256).alias("_h"), key).where(F.col(key).isNotNull())
    first = hashed.groupBy("_h").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _h is not null")
    later = hashed.join(first, "_h").where(F.col(key) != F.col("_first")).select(key).distinct()
    return docs.join(later, key, "left_anti").select(*docs.columns)


def _holds_any(texts: list[str]) -> Column:
    """Whether a text contains one of texts: one pass over it, however many there are."""

    @F.pandas_udf(BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for t in texts:
            automaton.add_word(t, 1)
        automaton.make_automaton()
        for b in batches:
            yield b.map(lambda t: isinstance(t, str) and next(automaton.iter(t), None) is not None).astype(bool)

    return run


def exclude_heldout(docs: DataFrame, heldout: DataFrame, text: str = "text", held: str = "text") -> DataFrame:
    """docs that contain no held-out text. Held-out texts go to the executors in blocks of a bounded size."""
    rows, chars = heldout.agg(F.count("*"), F.sum(F.length(held))).first()
    blocks = max(1, -(-rows // HELDOUT_ROWS), -(-(chars or 0) // HELDOUT_CHARS))
    for i in range(blocks):
        part = heldout.where(F.col(held).isNotNull() & (F.length(held) > 0)).select(F.col(held).alias("_held"))
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64("_held"), F.lit(blocks)) == i)
        if ahocorasick:
            texts = sorted({r["_held"] for r in part.collect()})
            docs = docs.where(~_holds_any(texts)(F.col(text))) if texts else docs
            continue
        docs = docs.join(F.broadcast(part), F.contains(F.col(text), F.col("_held")), "left_anti")
    return docs


def profile(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Counts and lengths per language and, with lang null and is_total 1, for all."""
    n = F.length(text)
    return docs.groupingSets([[F.col(lang)], []], F.col(lang)).agg(
        F.grouping(lang).cast("int").alias("is_total"), F.count("*").alias("documents"), F.sum(n).cast("long").alias("chars"),
        F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n.cast("double")), 6).alias("mean_chars"),
        F.round(F.avg((F.col(lang) == "en").cast("double")), 6).alias("english_share"),
    )


def split_manifest(docs: DataFrame, split: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per split: rows and a SHA-256 that changes with any row. Sums of parts of row hashes stand for the ordered list,
    so no split is gathered anywhere."""
    h = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.sha2(text, 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    summed = docs.groupBy(split).agg(F.count("*").alias("rows"), *(part(i).alias(f"_{i}") for i in range(8)))
    return summed.select(split, "rows", F.sha2(F.concat_ws("|", *(f"_{i}" for i in range(8))), 256).alias("manifest"))
