"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

1. Words of the benchmark items are the vocabulary, one for all items (its size
   is bounded by the benchmark). Each document becomes the list of its words'
   numbers, other words as one number; this table is all that later steps read.
2. Document frequencies over all passages (``PASSAGE`` words) of all documents
   give the TF-IDF weights.
3. Randomised SVD in one pass: every task adds up its part of Y = (A'A) Omega,
   A being the TF-IDF passages of all documents and Omega a random matrix of
   ``RANK`` + ``OVERSAMPLE`` columns. From Omega and Y the driver gets the leading
   right singular vectors V and values s of A (the Nystrom form of the method).
   What is sent depends on the vocabulary, not on the passages.
4. A word's place in the latent space is its row of V / s, at unit length so
   that a rare word counts as its weight says; a text's is the sum of its
   words' places by TF-IDF weight. Words outside the vocabulary have no place.
   All windows of ``2 STRIDE`` words, ``STRIDE`` apart, of every document are
   compared to all items (one of over ``LONG`` words: to its pieces) by the cosine
   in that space; from ``COSINE`` on they are candidates.
5. Around a candidate the longest common subsequence with the item is taken
   (bit-parallel) over all stretches of 1.5 times the item's length. A share of
   ``LCS`` of the item's words is a leak; from ``PARAPHRASE`` on it is one if the
   answer, the item's last sentence (the last third of an item of one
   sentence), is there to ``ANSWER``.

Result: a row per document row and item that it leaks: doc_id, item_id, cosine,
lcs (share), answer (share), kind (copy or paraphrase).

Defined cases: null, empty and word-less texts leak nothing and null items are
not searched; an item under ``MIN_ITEM`` words must be there word for word, and
is looked for as such, its cosine given as 1; a very long text is searched whole,
in memory that grows with that text; of places with one share the first is
reported; rows that repeat, and rows without doc_id, each give their rows; an
empty table on either side gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import materialize
from ragloom.llm.words import NOT_ALNUM, counts_of, lcs_bits, mix, pieces

PASSAGE, STRIDE, RANK, OVERSAMPLE, LONG = 32, 16, 80, 16, 64
COSINE, LCS, PARAPHRASE, ANSWER = 0.4, 0.75, 0.55, 0.8
MIN_ITEM = 8
#: Items that are searched in one pass over the documents.
ITEM_BLOCK = 20_000
#: Characters of all items, which the driver and each task hold, and different words of them: a task's part of the
#: sketch has 8 (RANK + OVERSAMPLE) bytes a word, 184 MB at most, and so has the driver's sum.
BENCHMARK_CHARS, BENCHMARK_WORDS = 50_000_000, 240_000
#: Words taken through the dense steps at once, and products of windows and items held at once.
PIECE_WORDS, PRODUCTS = 1 << 16, 1 << 22
#: Size of the table that tells quickly which words no item has.
SIEVE = 1 << 22
OUT = "doc_id long, item_id long, cosine double, lcs double, answer double, kind string"
FOUND = OUT.replace(" long", " string")


def encode(batches: Iterable[pd.DataFrame], vocabulary: np.ndarray) -> Iterator[pd.DataFrame]:
    """doc_id (as text, which pandas keeps whole beside nulls), n (words), ids (uint32 numbers; len(vocabulary) for words outside)."""
    sieve = np.zeros(1 << 20, bool)
    sieve[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    for batch in batches:
        ids, out = batch["doc_id"].tolist(), []
        for piece in pieces(batch["text"].tolist(), NOT_ALNUM):
            number = np.full(len(piece.hash), len(vocabulary), np.uint32)
            may = np.flatnonzero(sieve[(piece.hash & np.uint64(0xFFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(vocabulary, piece.hash[may]), len(vocabulary) - 1)
            hit = vocabulary[at] == piece.hash[may]
            number[may[hit]] = at[hit]
            for d in range(len(piece)):
                doc = ids[piece.first + d]
                out.append((doc, int(piece.of[d + 1] - piece.of[d]), number[piece.of[d] : piece.of[d + 1]].tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "n", "ids"])


def _runs(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Words of some whole documents in a row, words per document, doc_ids; about PIECE_WORDS, or one longer document."""
    part, sizes, docs, held = [], [], [], 0
    for doc, n, ids in zip(batch["doc_id"], batch["n"], batch["ids"], strict=True):
        if part and held + n > PIECE_WORDS:
            yield np.concatenate(part), np.array(sizes), docs
            part, sizes, docs, held = [], [], [], 0
        if n:
            part.append(np.frombuffer(ids, np.uint32))
            sizes.append(int(n))
            docs.append(doc)
            held += int(n)
    if part:
        yield np.concatenate(part), np.array(sizes), docs


def _passages(sizes: np.ndarray) -> np.ndarray:
    """For each word its passage, PASSAGE words of one document each."""
    per = -(-sizes // PASSAGE)
    return np.repeat(np.cumsum(per) - per, sizes) + counts_of(sizes) // PASSAGE


def _frequencies(batches: Iterable[pd.DataFrame], m: int) -> Iterator[pd.DataFrame]:
    df, passages = np.zeros(m + 1, np.int64), 0
    for batch in batches:
        for ids, sizes, _ in _runs(batch):
            passage = _passages(sizes)
            seen = np.unique(passage * (m + 1) + ids.astype(np.int64))
            df += np.bincount(seen % (m + 1), minlength=m + 1)
            passages += int(passage[-1]) + 1
    df[m] = passages
    at = np.flatnonzero(df)
    yield pd.DataFrame({"at": at, "df": df[at]})


def _gram(ids: np.ndarray, passage: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of these passages and their rows of A'A Omega before a word's own weight; omega: rows by weight."""
    inside = ids < len(omega)
    ids, passage = ids[inside], passage[inside]
    if not len(ids):
        return ids, np.zeros((0, omega.shape[1]))
    edge = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    y = np.add.reduceat(omega[ids], edge, axis=0)
    at = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(ids))))
    by = np.argsort(ids, kind="stable")
    heads, first = np.unique(ids[by], return_index=True)
    return heads, np.add.reduceat(y[at[by]], first, axis=0)


def _range(batches: Iterable[pd.DataFrame], omega: np.ndarray) -> Iterator[pd.DataFrame]:
    z = np.zeros(omega.shape, np.float64)
    for batch in batches:
        for ids, sizes, _ in _runs(batch):
            heads, rows = _gram(ids, _passages(sizes), omega)
            z[heads] += rows
    at = np.flatnonzero(z.any(axis=1))
    yield pd.DataFrame({"at": at, "z": pd.Series(list(z[at]), dtype=object)})


def latent(omega: np.ndarray, y: np.ndarray, rank: int) -> np.ndarray:
    """Places of words at unit length, from Omega and Y = (A'A) Omega; 0 for words of no passage."""
    shift = np.finfo(np.float64).eps * max(np.linalg.norm(y), 1e-300)
    core = omega.T @ (y + shift * omega)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    held = values > values[-1] * 1e-12
    v, s, _ = np.linalg.svd((y @ vectors[:, held]) / np.sqrt(values[held]), full_matrices=False)
    held = np.flatnonzero(s[:rank] > s[:1].max(initial=0) * 1e-9)  # s[0] is the largest
    places = v[:, held] / s[held]
    places[~y.any(axis=1)] = 0
    return (places / np.maximum(np.linalg.norm(places, axis=1), 1e-300)[:, None]).astype(np.float32)


class Items:
    def __init__(self, rows: list[tuple[str | None, str]]):
        self.rows = [(i, p.hash, _answer_words(t, len(p.hash))) for i, t in rows if isinstance(t, str) for p in [next(pieces([t], NOT_ALNUM))] if len(p.hash)]
        self.vocabulary = np.unique(np.concatenate([h for _, h, _ in self.rows])) if self.rows else np.zeros(0, np.uint64)
        self.ids = [np.searchsorted(self.vocabulary, h).astype(np.uint32) for _, h, _ in self.rows]

    def __len__(self) -> int:
        return len(self.rows)


def _answer_words(text: str, n: int) -> int:
    """Words of the last sentence, or of the last third where there is one sentence only."""
    sentences = [s for s in re.split(r"[.!?।]+", text) if s.strip()]
    if len(sentences) > 1:
        return max(1, min(n, len(next(pieces([sentences[-1]], NOT_ALNUM)).hash)))
    return max(1, n // 3)


def judge(item: list[int], answer: int, region: list[int]) -> tuple[float, float, str | None]:
    """Shares of item and answer found in order in region, and the kind of leak."""
    n = len(item)
    share = lcs_bits(item, region) / n
    if n < MIN_ITEM:
        whole = any(region[i : i + n] == item for i in range(len(region) - n + 1))
        return share, share, "copy" if whole else None
    if share < PARAPHRASE:
        return share, 0.0, None
    got = lcs_bits(item[n - answer :], region) / answer
    if share >= LCS:
        return share, got, "copy"
    return share, got, "paraphrase" if got >= ANSWER else None


class _Windows:
    """Windows of a run: document, words from lo to hi, and unit vector (0 where no word has a place)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray):
        begin = np.concatenate([[0], np.cumsum(sizes)])
        per = -(-sizes // STRIDE)
        first = np.cumsum(per) - per
        block = np.repeat(first, sizes) + counts_of(sizes) // STRIDE
        inside = np.flatnonzero(ids < len(places))
        sums = np.zeros((int(per.sum()) + 1, places.shape[1]), np.float32)
        if len(inside):
            at = block[inside]
            edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            sums[at[edge]] = np.add.reduceat(places[ids[inside]], edge, axis=0)
        windows = np.maximum(per - 1, 1)
        self.doc = np.repeat(np.arange(len(sizes)), windows)
        step = counts_of(windows)
        self.lo = begin[self.doc] + step * STRIDE
        self.hi = np.minimum(self.lo + 2 * STRIDE, begin[self.doc + 1])
        at = first[self.doc] + step
        self.vector = sums[at] + np.where((per[self.doc] > 1)[:, None], sums[at + 1], np.float32(0))
        self.vector /= np.maximum(np.linalg.norm(self.vector, axis=1), 1e-9)[:, None]


def _queries(item_ids: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items as unit vectors, one of over LONG words as one for each LONG words, LONG / 2 apart; and whose each is."""
    vectors, owner = [], []
    for t, ids in enumerate(item_ids):
        if len(ids) >= MIN_ITEM:
            for a in range(0, max(len(ids) - LONG // 2, 1), LONG // 2) if len(ids) > LONG else [0]:
                vectors.append(places[ids[a : a + LONG]].sum(axis=0))
                owner.append(t)
    q = np.stack(vectors) if vectors else np.zeros((0, places.shape[1]), np.float32)
    return q / np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None], np.array(owner, np.int64)


class _Bags:
    """How many of an item's words a region can have at most in common with it."""

    def __init__(self, item_ids: list[np.ndarray], m: int):
        self.m = m
        each = [np.unique(i, return_counts=True) for i in item_ids]
        self.keys = np.concatenate([t * (m + 1) + i.astype(np.int64) for t, (i, _) in enumerate(each)])  # ascending
        self.times = np.concatenate([k for _, k in each])
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.keys % SIEVE] = True

    def enough(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the regions lo..hi have ``least`` words in common with item t at least."""
        out = np.zeros(len(lo), bool)
        step = max(1, PRODUCTS // int((hi - lo).max(initial=1)))
        for a in range(0, len(lo), step):
            size, need = (hi - lo)[a : a + step], least[a : a + step]
            of = np.repeat(np.arange(len(size)), size)
            want = t[a : a + step][of] * (self.m + 1) + ids[lo[a : a + step][of] + counts_of(size)]
            may = np.flatnonzero(self.sieve[want % SIEVE])
            of, want = of[may], want[may]
            may = np.flatnonzero((np.bincount(of, minlength=len(size)) >= need)[of])  # with words as often as they come
            of, want = of[may], want[may]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            both, count = np.unique(of[hit] * len(self.keys) + at[hit], return_counts=True)
            out[a : a + step] = np.bincount(both // len(self.keys), weights=np.minimum(count, self.times[both % len(self.keys)]), minlength=len(size)) >= need
        return out


def _settle(item: list[int], answer: int, region: np.ndarray) -> tuple[float, float, str] | None:
    """The best leak of item in any stretch of region of 1.5 times its length (at least 16 words more), None if there is none."""
    n = len(item)
    reach = min(max(n + 16, n * 3 // 2), len(region))
    belongs = np.isin(region, item)
    hits = np.concatenate([[0], np.cumsum(belongs)])
    starts = np.flatnonzero(belongs[: len(region) - reach + 1])
    starts = np.unique(np.append(starts, len(region) - reach))
    inside = hits[starts + reach] - hits[starts]
    best = None
    for at in np.lexsort((starts, -inside)):
        most = min(inside[at] / n, 1.0)  # no subsequence is longer than this
        if most < PARAPHRASE or (best and most <= best[0]):
            break
        share, got, kind = judge(item, answer, region[starts[at] : starts[at] + reach].tolist())
        if kind and (best is None or share > best[0]):
            best = (share, got, kind)
    return best


def _verbatim(ids: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Documents of a run that hold item word for word."""
    last = len(ids) - len(item) + 1
    at = np.flatnonzero(ids[: max(last, 0)] == item[0])
    for j in range(1, len(item)):
        at = at[ids[at + j] == item[j]]
    return np.unique(doc[at[doc[at] == doc[at + len(item) - 1]]])


def _search(batches: Iterable[pd.DataFrame], names: list[str | None], item_ids: list[np.ndarray], answers: list[int], places: np.ndarray, cosine: float) -> Iterator[pd.DataFrame]:
    m = len(places)
    q, of_item = _queries(item_ids, places)
    items = [i.tolist() for i in item_ids]
    lengths = np.array([len(i) for i in item_ids])
    bags = _Bags(item_ids, m)
    short = [t for t, i in enumerate(items) if len(i) < MIN_ITEM]
    step = max(1, PRODUCTS // max(len(q), 1))
    for batch in batches:
        out: list[tuple] = []
        for ids, sizes, docs in _runs(batch):
            begin = np.concatenate([[0], np.cumsum(sizes)])
            if short:
                doc_of = np.repeat(np.arange(len(sizes)), sizes)
                out += [(docs[d], names[t], 1.0, 1.0, 1.0, "copy") for t in short for d in _verbatim(ids, doc_of, item_ids[t])]
            w = _Windows(ids, sizes, places)
            near = []
            for a in range(0, len(w.doc), step):
                product = w.vector[a : a + step] @ q.T
                i, j = np.nonzero(product >= cosine)
                around = lengths[of_item[j]] + STRIDE
                lo, hi = np.maximum(begin[w.doc[a + i]], w.lo[a + i] - around), np.minimum(begin[w.doc[a + i] + 1], w.hi[a + i] + around)
                ok = bags.enough(ids, lo, hi, of_item[j], PARAPHRASE * lengths[of_item[j]])
                near.append(np.rec.fromarrays([w.doc[a + i][ok], of_item[j][ok], lo[ok], hi[ok], product[i, j][ok]], names="d,t,lo,hi,c"))
            found = np.concatenate(near)
            found = found[np.lexsort((found["lo"], found["t"], found["d"]))]
            # Regions of one document and item that overlap are one region.
            same = np.append(False, (found["d"][1:] == found["d"][:-1]) & (found["t"][1:] == found["t"][:-1])) if len(found) else np.zeros(0, bool)
            best: dict[tuple[int, int], tuple] = {}
            k = 0
            while k < len(found):
                e, hi = k + 1, found["hi"][k]
                while e < len(found) and same[e] and found["lo"][e] <= hi:
                    hi, e = max(hi, found["hi"][e]), e + 1
                d, t = int(found["d"][k]), int(found["t"][k])
                got = _settle(items[t], answers[t], ids[found["lo"][k] : hi])
                if got and ((d, t) not in best or got[0] > best[d, t][1]):
                    best[d, t] = (float(found["c"][k:e].max()), *got)
                k = e
            out += [(docs[d], names[t], *v) for (d, t), v in best.items()]
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "lcs", "answer", "kind"])


def _random(n: int, k: int) -> np.ndarray:
    return (mix(np.arange(1, n * k + 1, dtype=np.uint64)).astype(np.float64) / 2**63 - 1).reshape(n, k)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text), of ``BENCHMARK_CHARS`` and ``BENCHMARK_WORDS`` at most: a larger
    one is refused, to be searched in parts."""
    spark = docs.sparkSession
    if (chars := benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > BENCHMARK_CHARS:
        raise ValueError(f"a benchmark of {chars} characters; search it in parts of {BENCHMARK_CHARS}")
    items = Items([(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("string"), "text").collect()])
    if not len(items):
        return spark.createDataFrame([], OUT)
    vocabulary, m = items.vocabulary, len(items.vocabulary)
    if m > BENCHMARK_WORDS:
        raise ValueError(f"a benchmark of {m} different words; search it in parts of {BENCHMARK_WORDS}")
    lists = materialize(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(lambda b: encode(b, vocabulary), "doc_id string, n long, ids binary"), "decontaminate-words", batch_rows=1000)

    df = np.zeros(m + 1)
    seen = lists.mapInPandas(lambda b: _frequencies(b, m), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()  # a row per word of the items
    df[seen["at"].to_numpy()] = seen["df"].to_numpy()
    idf = np.log((df[m] + 1) / (df[:m] + 1)) + 1

    columns = min(rank + OVERSAMPLE, m)
    omega = _random(m, columns)
    weighted = (omega * idf[:, None]).astype(np.float32)
    parts = lists.mapInPandas(lambda b: _range(b, weighted), "at long, z array<double>")
    y = np.zeros((m, columns))
    sums = parts.groupBy("at").agg(*(F.sum(F.col("z")[j]).alias(f"z{j}") for j in range(columns))).toArrow()  # vocabulary x columns
    at = sums["at"].to_numpy()
    for j in range(columns):
        y[at, j] = sums[f"z{j}"].to_numpy()
    places = latent(omega, y * idf[:, None], rank) * idf[:, None].astype(np.float32)
    found = None
    for a in range(0, len(items), ITEM_BLOCK):
        block = items.rows[a : a + ITEM_BLOCK]
        names, ids, answers = [i for i, _, _ in block], items.ids[a : a + ITEM_BLOCK], [x for _, _, x in block]
        out = lists.mapInPandas(lambda b, names=names, ids=ids, answers=answers: _search(b, names, ids, answers, places, cosine), FOUND)
        found = out if found is None else found.unionByName(out)
    return found.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


#: Leaking ids that are sent to every executor (8 bytes each); beyond, a shuffled anti join.
BROADCAST_IDS = 500_000


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id leaks no item."""
    gone = materialize(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "decontaminate-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
