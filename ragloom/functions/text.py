"""Text functions of ingestion: normalisation, identifiers, chunks, hashed embeddings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ragloom.functions import vectors

SENTENCE = r"[^.!?।]+[.!?।]*"
TOKEN = r"[\p{L}\p{M}\p{N}]+"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC; ASCII never leaves the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text))


def document_id(source: Column, key: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, key.cast("string"), text), 256)


def uuid_of(text: Column) -> Column:
    """A UUID (version 5 layout) from the SHA-1 of text."""
    h = F.sha1(text.cast("binary"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fixed_chunks(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Array of (start, text), starts 0-based and size - overlap apart; no chunk lies wholly in the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int")
    make = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > 0, make).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def packed(parts: Column, size: int = 200) -> Column:
    """Neighbouring sentences joined by spaces as long as they fit; a longer sentence is a chunk of its own."""
    done = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def add(acc, s):
        fits = F.length(acc["open"]) + 1 + F.length(s) <= size
        return (
            F.when(acc["open"] == "", F.struct(acc["out"].alias("out"), s.alias("open")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat_ws(" ", acc["open"], s).alias("open")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(acc["open"])).alias("out"), s.alias("open")))
        )

    return F.aggregate(parts, done, add, lambda acc: F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


def semantic(parts: Column, least: float = 0.3, dim: int = 64) -> Column:
    """Sentences joined by spaces as long as neighbours' hashed vectors have a cosine (9 digits) of ``least`` or more."""
    both = F.transform(parts, lambda s: F.struct(s.alias("s"), hash_embed(s, dim).alias("v")))
    near = lambda p, i: F.round(vectors.dot(F.get(p, i)["v"], F.get(p, i - 1)["v"]), 9) >= least
    first = F.transform(F.array(both), lambda p: F.filter(F.transform(p, lambda x, i: F.when((i == 0) | ~near(p, i), i)), lambda i: i.isNotNull()))[0]
    slices = lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(parts, a + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - a), " "))
    return F.transform(F.array(first), slices)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def hash_slot(token: Column, dim: int = 64) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim


def hash_embed(text: Column, dim: int = 64) -> Column:
    """Token counts by slot, unit length (all 0 without a token): a deterministic embedder for tests."""
    slots = F.transform(tokens(text), lambda t: hash_slot(t, dim))
    counts = F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))[0]
    return F.transform(F.array(counts), lambda c: F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0])[0]


def preview(text: Column, most: int = 80) -> Column:
    """The beginning, for logs."""
    return F.substring(text, 1, most)
