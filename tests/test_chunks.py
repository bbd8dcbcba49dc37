"""Chunks by sentence and by meaning against plain loops, on the documents table."""

import hashlib
import math

import regex

import __spark_entry__ as entry


def sentences(text):
    return [s for s in (x.strip(" ") for x in regex.findall(r"[^.!?।]+[.!?।]*", text)) if s]


def vector(sentence):
    v = [0.0] * 64
    for t in regex.findall(r"[\p{L}\p{M}\p{N}]+", sentence.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += 1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def by_meaning(text):
    out, before = [], None
    for s in sentences(text):
        v = vector(s)
        if before is not None and sum(a * b for a, b in zip(before, v, strict=True)) >= 0.3:
            out[-1] += " " + s
        else:
            out.append(s)
        before = v
    return out


def by_length(text):
    out, held = [], ""
    for s in sentences(text):
        if not held:
            held = s
        elif len(held) + 1 + len(s) <= 200:
            held += " " + s
        else:
            out.append(held)
            held = s
    return [*out, held] if held else out


def check(spark, sf_dir, name, loop):
    want = {(r["doc_id"], i, len(c), hashlib.md5(c.encode()).hexdigest()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, c in enumerate(loop(r["text"]))}
    got = {tuple(r) for r in entry.queries()[name](spark, sf_dir).select("doc_id", "position", "chars", "digest").collect()}
    # Equal vectors may differ in the last digit where a cosine is 0.3 to 15 digits; no more than a chunk in a thousand.
    assert len(got ^ want) <= len(want) // 1000


def test_chunk_sentence(spark, sf_dir):
    check(spark, sf_dir, "chunk_sentence", by_length)


def test_chunk_semantic(spark, sf_dir):
    check(spark, sf_dir, "chunk_semantic", by_meaning)
