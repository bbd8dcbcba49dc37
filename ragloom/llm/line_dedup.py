"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's frequency is the number of the host's
pages that contain it divided by all pages of the host. Pages of a host with
equal text are one page in both numbers, so copies of a page don't make its
lines a part of the site. Lines that repeat on pages and whose frequency is
above ``RATIO`` are boilerplate and are dropped from every page of that host.

Only hashes are shuffled, (host, two of the line, one of the page), counted
before the shuffle. The boilerplate lines of a host are at most (mean lines a
page) / RATIO, so a host's list is small however many pages it has. Texts stay
where they are read up to ``BROADCAST_LINES`` boilerplate lines in all; beyond,
they are dealt once by host and salt to the lists.

Defined cases: null text is no page and stays null with 0 lines; a null host is
a host of its own; empty texts and lines without a word stay as they are; a
frequency equal to the ratio stays; rows that repeat are one page, and each row
is cleaned; a very long text is split whole, in memory that grows with it; an
empty table gives none; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import materialize
from ragloom.llm.skew import attach

RATIO = 0.05
#: Boilerplate lines (16 bytes each) that are sent to every executor; beyond, a salted join by host.
BROADCAST_LINES = 200_000


def _wordy(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """A row per boilerplate line: _host, a, b (the line's key)."""
    named = pages.select(_host(host), F.col(text).alias("_text")).where("_text is not null").withColumn("_page", F.xxhash64("_text"))
    totals = named.groupBy("_host").agg(F.count_distinct("_page").alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("_text", "\n", -1), _wordy), _key))
    seen = named.select("_host", "_page", F.explode(keys).alias("_k")).groupBy("_host", "_k.a", "_k.b").agg(F.count_distinct("_page").alias("_with"))
    return seen.where("_with > 1").join(totals, "_host").where(F.col("_with") > F.col("_pages") * F.lit(ratio)).select("_host", "a", "b")


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("_host")


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """pages with ``text`` cleaned, and _n_lines and _n_dropped (long)."""
    common = materialize(boilerplate(pages, host, text, ratio), "line-dedup")
    found = common.groupBy("_host").agg(F.collect_list(F.struct("a", "b")).alias("_lines"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row"), F.col(text).alias("_text"), _host(host))
    with_lines = attach(rows, found, ["_host"], common.count(), BROADCAST_LINES, ["_text"])
    lines = F.when(F.col("_text").isNotNull(), F.split("_text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(_wordy(x) & F.array_contains("_lines", _key(x)))))
    done = with_lines.withColumn("_cut", F.struct(F.size(lines).cast("long").alias("n"), kept.alias("kept")))
    dropped = F.col("_cut.n") - F.size("_cut.kept")
    cleaned = F.when(dropped > 0, F.array_join("_cut.kept", "\n")).otherwise(F.col("_text"))
    out = [cleaned.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in pages.columns]
    return done.select(*out, F.col("_cut.n").alias("_n_lines"), dropped.cast("long").alias("_n_dropped"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with boilerplate lines dropped, the same columns; n_chars, if there is one, follows the text."""
    out = drop_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
