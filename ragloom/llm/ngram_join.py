"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of 0.8 or more; the result names each document's component of links. Exact for
all documents, up to equal 64-bit hashes.

1. ``_postings``: shingles are hashed and dealt to buckets of an inverted
   index. A shingle that a task sees in several documents is known to be shared
   at once; only a notice of it goes to its bucket, so a shingle that a third
   of all documents hold fills no bucket.
2. ``_lookup``: a bucket tells which of its shingles are in two documents or
   more. Only those can overlap; a document with fewer of them than
   ceil(0.8 n) links to nothing, which is the T-occurrence bound and settles
   nearly all documents.
3. Documents with equal sets form classes; one of each goes on, through the
   index once more (``_again``), which counts the classes of each shingle.
4. Two sets that link share one of the first n - T + 1 shingles of any common
   order (the others, T - 1 of them, are what DivideSkip may set aside). Ours
   goes by how many classes hold a shingle, those of one class first; shingles
   of ``HEAVY`` classes in one task are last, uncounted. Equal shingles among
   these tie candidates to the smallest id that holds them; connected
   components of those stars contain all links.
5. ``_search``: within such components, in blocks of bounded size, DivideSkip:
   the short inverted lists of a document are merged by a heap, documents that
   reach the count left to the short lists are probed by binary search in the
   long lists. Every pair that links is verified, none is passed over because
   its documents hang together already. A component beyond a block's size is cut
   by set size (factor 1.25) and hash; all pairs of parts that may link become
   blocks, so each pair of documents is in one block.
6. Components of the links found.

``join`` gives one row per document with its class (documents of equal sets),
its number of links (classes of other sets that it links to) and its component;
``pairs`` gives the links themselves, between the classes' smallest documents.

Defined cases: null, empty and word-less texts have no shingles and are alone;
under five words the whole sequence is the one shingle; a very long text is read
whole, in memory that grows with it; rows with one doc_id are one document, whose
set and n_shingles are those of its rows united; rows without doc_id are alone,
with class and component null; an overlap equal to the bound links; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.components import components
from ragloom.llm.scratch import materialize
from ragloom.llm.skew import attach, even_keys, meet
from ragloom.llm.words import SPACES, grams, mix, pieces

N, PERCENT = 5, 80
#: Shingles a task holds before it deals them out, and a block's shingles at most.
TASK_SHINGLES, BLOCK_SHINGLES = 600_000, 400_000
TEXT_ROWS = 1000
HEAVY = 64
#: A bucket of the index is for so many bytes of text, and there are two for each shuffle partition at least.
BUCKET_BYTES, BUCKETS_PER_PARTITION = 48 << 20, 2
BROADCAST_CLASSES, BROADCAST_IDS = 200_000, 500_000
#: DivideSkip's factor: of T lists at most T / (MU * log2(longest) + 1) are set aside.
MU = 0.01
#: Postings of a document's short lists that go through the heap; of more, the same counts are taken in one pass of numpy.
HEAP = 512
#: Candidates of a document that are probed one by one in its long lists; of more, these lists are counted as well.
PROBES = 64
#: Pairs in one Arrow batch of ``pairs``.
PAIR_ROWS = 100_000


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def shingles(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, texts, text of each shingle relative to it, shingle): distinct per text, sorted by (text, shingle)."""
    for piece in pieces(texts, SPACES):
        of, n_words = piece.of, np.diff(piece.of)
        g = grams(piece.hash, N)
        doc = np.repeat(np.arange(len(n_words)), np.maximum(n_words - N + 1, 0))
        start = np.repeat(of[:-1], np.maximum(n_words - N + 1, 0))
        first = np.repeat(np.cumsum(np.maximum(n_words - N + 1, 0)) - np.maximum(n_words - N + 1, 0), np.maximum(n_words - N + 1, 0))
        g = g[start + np.arange(len(doc)) - first]
        short = [(d, mix(grams(piece.hash[of[d] : of[d + 1]], int(n_words[d])) + np.uint64(n_words[d]))[0]) for d in np.flatnonzero((n_words > 0) & (n_words < N))]
        if short:
            doc, g = np.append(doc, [d for d, _ in short]), np.append(g, np.array([s for _, s in short], np.uint64))
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        yield piece.first, len(piece), doc[new], g[new]


def _blob(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


POSTINGS = "bucket long, kind int, docs binary, counts binary, shingles binary"


class _Dealer:
    """Gathers sets and deals their shingles to buckets. keys: a bucket's name in the result.

    kind 0: sizes (docs, counts); 1: shingles with their documents; 2: shingles that ``heavy`` documents or more here
    hold, whole, for any bucket; 3: a notice of these to their own bucket, once a task."""

    def __init__(self, keys: list[int], heavy: int):
        self.keys, self.heavy, self.turn = keys, heavy, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.lengths, self.found, self.held = [], [], [], [], 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, found: np.ndarray) -> bool:
        """ids with their sets' sizes, and lengths of the runs of found that are theirs. Whether it is time to deal."""
        for held, x in ((self.ids, ids), (self.sizes, sizes), (self.lengths, lengths), (self.found, found)):
            held.append(x)
        self.held += len(found)
        return self.held >= TASK_SHINGLES

    def deal(self) -> Iterator[pd.DataFrame]:
        if not self.ids:
            return
        buckets = len(self.keys)
        docs, g = np.concatenate(self.ids), np.concatenate(self.found)
        doc = np.repeat(np.arange(len(docs)), np.concatenate(self.lengths))
        out = [(self.turn % buckets, 0, _blob(docs, np.int64), _blob(np.concatenate(self.sizes), np.int64), b"")]
        self.turn += 1
        order = np.argsort(g, kind="stable")
        edge = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(g)))
        many = np.zeros(len(g), bool)
        many[order[np.repeat(count >= self.heavy, count)]] = True
        notices = g[order][edge[count >= self.heavy]]
        for kind, d, s in ((1, doc[~many], g[~many]), (2, doc[many], g[many]), (3, None, notices)):
            bucket = _bucket(s, buckets)
            if kind == 2:  # needs no lookup, so it goes where there is room; its bucket's number is part of the shingle
                s, bucket = _named(s, bucket), doc[many] % buckets
            by = np.argsort(bucket, kind="stable")
            s, at = s[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            d = None if d is None else d[by]
            for b in np.flatnonzero(np.diff(at)):
                ss = s[at[b] : at[b + 1]]
                body = _blob(ss, np.uint64) if kind > 1 else _blob(ss & np.uint64(0xFFFFFFFF), np.uint32) + _blob(ss >> np.uint64(32) & np.uint64(0xFFFF), np.uint16)
                who, counts = (np.zeros(0, np.int64),) * 2 if d is None else np.unique(d[at[b] : at[b + 1]], return_counts=True)
                out.append((int(b), kind, _blob(docs[who], np.int64), _blob(counts, np.int32), body))
        self.clear()
        yield pd.DataFrame([(self.keys[r[0]], *r[1:]) for r in out], columns=["bucket", "kind", "docs", "counts", "shingles"])


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _named(g: np.ndarray, bucket) -> np.ndarray:
    """What stands for a shingle: its lower 48 bits and the lower 16 of its bucket's number, which its upper 24 bits give."""
    return g & np.uint64(0xFFFFFFFFFFFF) | (np.asarray(bucket).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)


def _postings(batches: Iterable[pd.DataFrame], keys: list[int]) -> Iterator[pd.DataFrame]:
    """Of texts; a shingle of two documents here is known to be shared."""
    dealer = _Dealer(keys, 2)
    for batch in batches:
        doc_ids = batch["doc_id"].to_numpy(np.int64)
        for first, n_texts, doc, g in shingles(batch["text"].tolist()):
            n = np.bincount(doc, minlength=n_texts)
            if dealer.add(doc_ids[first : first + n_texts], n, n, g):
                yield from dealer.deal()
    yield from dealer.deal()


def _again(batches: Iterable[pd.DataFrame], keys: list[int], heavy: int) -> Iterator[pd.DataFrame]:
    """Of the sets of classes; a shingle of heavy classes here is known to be frequent."""
    dealer = _Dealer(keys, heavy)
    for batch in batches:
        for doc, n, s in zip(batch["doc_id"], batch["n"], batch["shingles"], strict=True):
            s = mix(np.frombuffer(s, np.uint64))
            if dealer.add(np.array([doc], np.int64), np.array([n], np.int64), np.array([len(s)]), s):
                yield from dealer.deal()
    yield from dealer.deal()


SPREAD = "part long, kind int, docs binary, counts binary, shingles binary, held binary"
UNCOUNTED = 0xFFFFFFFF


def _lookup(postings: pd.DataFrame, numbers: dict[int, int], keys: list[int]) -> pd.DataFrame:
    """One bucket: the documents of each shingle that is in two or more, dealt on by document. numbers: of buckets
    by name; keys: a part's name in the result. kind 0 sizes, 2 shingles; counts of shingles: runs of documents, then how many hold each (UNCOUNTED if
    a task had it from too many to send)."""
    parts = len(keys)
    number = numbers[int(postings["bucket"].iloc[0])]
    docs: list[np.ndarray] = [np.zeros(0, np.int64)]
    toks: list[np.ndarray] = [np.zeros(0, np.uint64)]
    known: list[np.ndarray] = [np.zeros(0, np.uint64)]
    ready: list[tuple[np.ndarray, ...]] = []
    size_docs, size_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind, d, c, s in zip(postings["kind"], postings["docs"], postings["counts"], postings["shingles"], strict=True):
        d = np.frombuffer(d, np.int64)
        if kind == 0:
            size_docs.append(d)
            size_n.append(np.frombuffer(c, np.int64))
        elif kind == 1:
            n = len(s) // 6
            docs.append(np.repeat(d, np.frombuffer(c, np.int32)))
            toks.append(np.frombuffer(s, np.uint32, n).astype(np.uint64) | np.frombuffer(s, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
        elif kind == 2:
            s = np.frombuffer(s, np.uint64)
            ready.append((np.repeat(d, np.frombuffer(c, np.int32)), s, np.full(len(s), UNCOUNTED, np.uint32)))
        else:
            known.append(np.frombuffer(s, np.uint64) & np.uint64(0xFFFFFFFFFFFF))
    doc, tok, extra = np.concatenate(docs), np.concatenate(toks), np.unique(np.concatenate(known))
    order = np.lexsort((doc, tok))
    doc, tok = doc[order], tok[order]
    if len(tok):
        new = np.append(True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1]))  # rows of one doc_id count once
        doc, tok = doc[new], tok[new]
        edge = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        length = np.diff(np.append(edge, len(tok)))
        count = length.astype(np.uint32)
        if len(extra):
            at = np.minimum(np.searchsorted(extra, tok[edge]), len(extra) - 1)
            count[extra[at] == tok[edge]] = UNCOUNTED
        keep = np.repeat(count > 1, length)
        ready.append((doc[keep], _named(tok[keep], number), np.repeat(count, length)[keep]))
    out: list[tuple] = []
    sizes = (np.concatenate(size_docs), np.concatenate(size_n), None)
    found = tuple(np.concatenate(x) for x in zip(*ready, strict=True)) if ready else (doc[:0], tok[:0], np.zeros(0, np.uint32))
    for kind, (d, v, n) in ((0, sizes), (2, found)):
        part = _part_of(d, parts)
        by = np.lexsort((d, part))
        d, v, part = d[by], v[by], part[by]
        edge = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            here = slice(edge[p], edge[p + 1])
            if kind == 0:
                out.append((keys[p], 0, _blob(d[here], np.int64), _blob(v[here], np.int64), b"", b""))
            else:
                at, counts = np.unique(d[here], return_counts=True)
                out.append((keys[p], 2, _blob(at, np.int64), _blob(counts, np.int32), _blob(v[here], np.uint64), _blob(n[by][here], np.uint32)))
    return pd.DataFrame(out, columns=["part", "kind", "docs", "counts", "shingles", "held"])


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """One part: documents (ascending) with their rows and size, and each one's shingles from lo to hi, with their counts."""
    size = rows[rows["kind"] == 0]
    d = np.concatenate([np.frombuffer(x, np.int64) for x in size["docs"]] or [np.zeros(0, np.int64)])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in size["counts"]] or [np.zeros(0, np.int64)])
    order = np.lexsort((n, d))
    d, n = d[order], n[order]
    last = np.append(d[1:] != d[:-1], True) if len(d) else np.zeros(0, bool)
    times = np.diff(np.append(-1, np.flatnonzero(last)))
    d, n = d[last], n[last]
    united = rows[rows["kind"] == 4]
    for doc, size in zip(united["docs"], united["counts"], strict=True):
        n[np.searchsorted(d, np.frombuffer(doc, np.int64))] = np.frombuffer(size, np.int64)
    rest = rows[rows["kind"] == 2]
    doc = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(c, np.int32)) for x, c in zip(rest["docs"], rest["counts"], strict=True)] or [np.zeros(0, np.int64)])
    tok = np.concatenate([np.frombuffer(x, np.uint64) for x in rest["shingles"]] or [np.zeros(0, np.uint64)])
    held = np.concatenate([np.frombuffer(x, np.uint32) for x in rest["held"]] or [np.zeros(0, np.uint32)])
    order = np.lexsort((tok, doc))
    doc, tok, held = doc[order], tok[order], held[order]
    if len(tok):
        new = np.append(True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1]))
        doc, tok, held = doc[new], tok[new], held[new]
    return d, times, n, tok, held, np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")


def _rows_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document and shingle, of few texts."""
    for batch in batches:
        doc_ids = batch["doc_id"].to_numpy(np.int64)
        for first, _, doc, g in shingles(batch["text"].tolist()):
            yield pd.DataFrame({"doc_id": doc_ids[first + doc], "shingle": g.astype(np.int64)})


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts


def _sizes(batches: Iterable[pd.DataFrame], keys: list[int]) -> Iterator[pd.DataFrame]:
    """Sizes of united sets, for their documents' parts."""
    for batch in batches:
        d, n = batch["doc_id"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
        part = _part_of(d, len(keys))
        out = [(keys[p], 4, _blob(d[part == p], np.int64), _blob(n[part == p], np.int64), b"", b"") for p in np.unique(part)]
        yield pd.DataFrame(out, columns=["part", "kind", "docs", "counts", "shingles", "held"])


def _united(docs: DataFrame, keys: list[int]) -> DataFrame | None:
    """Sizes of the sets of documents of several rows; None if there are none."""
    repeated = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "join-united")
    if (k := repeated.count()) == 0:
        return None
    rows = docs.join(F.broadcast(repeated) if k <= BROADCAST_IDS else repeated, "doc_id", "left_semi")
    return rows.mapInPandas(_rows_of, "doc_id long, shingle long").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).mapInPandas(lambda b: _sizes(b, keys), SPREAD)


DOCS = "doc_id long, rows long, n long, a long, b long, shingles binary"


def _documents(rows: pd.DataFrame) -> pd.DataFrame:
    """One part: a row per document; a, b (a hash of the set) where all its shingles are shared, shingles where it may link."""
    d, times, n, tok, _, lo, hi = _gathered(rows)
    out = []
    for i in range(len(d)):
        s = tok[lo[i] : hi[i]]
        a = b = blob = None
        if len(s) and len(s) >= needed(int(n[i])):
            blob = s.tobytes()
            if len(s) >= n[i]:
                m = mix(s)
                a, b = int(m.sum(dtype=np.uint64).astype(np.int64)), int(mix(m + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64))
        out.append((d[i], times[i], n[i], a, b, blob))
    frame = pd.DataFrame(out, columns=["doc_id", "rows", "n", "a", "b", "shingles"], dtype=object)
    return frame.assign(**{c: pd.array(frame[c].tolist(), dtype="Int64") for c in ("doc_id", "rows", "n", "a", "b")})  # never by way of floats


def _prefixes(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of the classes: of each that may still link the shared ones among the first n - T + 1 of its shingles, those
    that fewest classes hold first."""
    d, _, n, tok, held, lo, hi = _gathered(rows)
    ids, toks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in range(len(d)):
        s, size, t = tok[lo[i] : hi[i]], int(n[i]), int(needed(int(n[i])))
        if len(s) and len(s) >= t:
            s = s[np.lexsort((s, held[lo[i] : hi[i]]))[: size - t + 1 - max(size - len(s), 0)]]
            ids.append(np.full(len(s), d[i]))
            toks.append(s)
    return pd.DataFrame({"doc_id": np.concatenate(ids), "shingle": np.concatenate(toks).astype(np.int64)})


def merge_counts(lists: list[np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from first to last - 1 in ascending lists, and how many lists have each."""
    lists = [x[np.searchsorted(x, first) : np.searchsorted(x, last)] for x in lists]
    if sum(map(len, lists)) > HEAP:
        counts = np.bincount(np.concatenate(lists) - first)
        return np.flatnonzero(counts) + first, counts[counts > 0]
    found, counts = [], []
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    while heap:
        y, k, at = heap[0]
        if found and found[-1] == y:
            counts[-1] += 1
        else:
            found.append(y)
            counts.append(1)
        if at + 1 < len(lists[k]):
            heapq.heapreplace(heap, (int(lists[k][at + 1]), k, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(found, np.int64), np.array(counts, np.int64)


def divide_skip(n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, both: bool, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a block in order of n: a document's number, those before it that it links to, and the overlaps.

    side and both: with both False only pairs from different sides count."""
    m = len(n)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    toks = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    by = np.argsort(toks, kind="stable")
    lists, owner = toks[by], owner[by]
    heads, lo, count = np.unique(lists, return_index=True, return_counts=True)
    longest = int(count.max()) if len(count) else 1
    for x in range(m):
        t = int(needed(n[x], percent))
        at = np.searchsorted(heads, sets[x])
        at = at[count[at] > 1]
        first = int(np.searchsorted(n, needed(n[x], percent)))  # smaller sets can't link
        if len(at) < t or first == x:
            continue
        at = at[np.argsort(count[at], kind="stable")]
        aside = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        fit, hits = merge_counts([owner[lo[k] : lo[k] + count[k]] for k in short], first, x)
        may = (hits >= t - aside) & (both | (side[fit] != side[x]))
        fit, hits = fit[may], hits[may]
        if len(fit) <= PROBES:
            for at, y in enumerate(fit) if len(long) else ():
                spot = np.minimum(np.searchsorted(sets[y], heads[long]), len(sets[y]) - 1)
                hits[at] += np.count_nonzero(sets[y][spot] == heads[long])
        else:
            more, counts = merge_counts([owner[lo[k] : lo[k] + count[k]] for k in long], first, x)
            hits += np.append(counts, 0)[np.where(np.isin(fit, more), np.searchsorted(more, fit), len(more))]
        linked = 100 * hits >= percent * (n[x] + n[fit] - hits)
        if linked.any():
            yield x, fit[linked], hits[linked]


def _linked(block: pd.DataFrame) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    block = block.iloc[np.lexsort((block["doc_id"], block["n"]))]
    sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
    return block["doc_id"].to_numpy(np.int64), divide_skip(block["n"].to_numpy(np.int64), sets, block["side"].to_numpy(), bool(block["own"].iloc[0]))


LINKS = "a long, b long, links long"


def _search(block: pd.DataFrame) -> pd.DataFrame:
    """Documents b of a block that link: the smallest one a that b hangs together with there, and b's number of links there."""
    ids, found = _linked(block)
    group, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for x, ys, _ in found:
        links[x] += len(ys)
        links[ys] += 1
        joined = np.unique(group[ys])
        if len(joined) > 1 or joined[0] != group[x]:
            group[np.isin(group, np.append(joined, group[x]))] = joined[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    at = np.flatnonzero(links)
    return pd.DataFrame({"a": least[group[at]], "b": ids[at], "links": links[at]})


def _pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block to links, some at a time."""
    held: list[pd.DataFrame] = []
    frame = lambda part: pd.DataFrame(dict(zip(("a", "b", "overlap"), map(np.concatenate, zip(*part, strict=True)), strict=True)))

    def settle() -> Iterator[pd.DataFrame]:
        ids, found = _linked(pd.concat(held, ignore_index=True))
        part: list[tuple[np.ndarray, ...]] = []
        size = 0
        for x, ys, overlap in found:
            part.append((np.minimum(ids[x], ids[ys]), np.maximum(ids[x], ids[ys]), overlap))
            size += len(ys)
            if size >= PAIR_ROWS:
                yield frame(part)
                part, size = [], 0
        if part:
            yield frame(part)

    for batch in batches:
        for _, rows in batch.groupby((batch["_block"] != batch["_block"].shift()).cumsum()):
            if held and held[-1]["_block"].iloc[0] != rows["_block"].iloc[0]:
                yield from settle()
                held.clear()
            held.append(rows)
    if held:
        yield from settle()


def _blocks(reps: DataFrame, near: DataFrame) -> DataFrame:
    """reps with the blocks they take part in: _block, side, own."""
    placed = reps.join(near, reps["doc_id"] == near["id"], "left").withColumn("comp", F.coalesce("component", "doc_id")).select("doc_id", "n", "shingles", "comp")
    weight = F.length("shingles") / 8
    sizes = materialize(placed.groupBy("comp", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).alias("class")).agg(F.sum(weight).alias("w"), F.count("*").alias("k")), "join-sizes")
    whole = sizes.groupBy("comp").agg(F.sum("w").alias("w"), F.sum("k").alias("k")).where("k > 1")
    small = whole.where(F.col("w") <= BLOCK_SHINGLES)
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = max(parts, math.ceil((small.agg(F.sum("w")).first()[0] or 0) / BLOCK_SHINGLES))
    out = placed.join(small.select("comp"), "comp", "left_semi").select("doc_id", "n", "shingles", F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.lit(packs)).cast("string")).alias("_block"), F.lit(0).alias("side"), F.lit(True).alias("own"))
    if whole.where(F.col("w") > BLOCK_SHINGLES).isEmpty():
        return out
    cut = materialize(sizes.join(whole.where(F.col("w") > BLOCK_SHINGLES).select("comp"), "comp", "left_semi").select("comp", "class", F.ceil(F.col("w") / (BLOCK_SHINGLES / 2)).cast("int").alias("s")), "join-cut")
    other = cut.select("comp", F.col("class").alias("oc"), F.col("s").alias("os"))
    beside = cut.join(other, "comp").where(F.abs(F.col("oc") - F.col("class")) <= 1).groupBy("comp", "class", "s").agg(F.collect_list(F.struct("oc", "os")).alias("others"))
    beside = materialize(beside, "join-beside")
    large = placed.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)))
    large = attach(large, beside, ["comp", "class"], beside.count(), BROADCAST_CLASSES, ["doc_id"]).where("others is not null").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int"))
    pairs = large.withColumn("o", F.explode("others")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("o.os") - 1)))
    me, you = F.struct(F.col("class").alias("c"), F.col("i").alias("i")), F.struct(F.col("o.oc").alias("c"), F.col("j").alias("i"))
    name = F.concat_ws("/", F.col("comp").cast("string"), F.to_json(F.struct(F.least(me, you).alias("x"), F.greatest(me, you).alias("y"))))
    return out.unionByName(pairs.select("doc_id", "n", "shingles", name.alias("_block"), F.when(me < you, 0).otherwise(1).alias("side"), (me == you).alias("own")))


def join(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links, one row per document."""
    return _join(docs, buckets)[0]


def pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """a, b, overlap: every link between classes, by their smallest documents, a < b."""
    blocks = _candidates(docs, buckets)[2]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "_block").sortWithinPartitions("_block").mapInPandas(_pairs, "a long, b long, overlap long")


def _candidates(docs: DataFrame, buckets: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sets' sizes; classes' members; and blocks of classes that may link."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = buckets or max(BUCKETS_PER_PARTITION * parts, -(-size // BUCKET_BYTES))
    keys = even_keys(spark, count, parts)
    numbers, places = {k: i for i, k in enumerate(keys)}, keys[: max(parts, count // BUCKETS_PER_PARTITION)]
    lists = docs.mapInPandas(lambda b: _postings(b, keys), POSTINGS)
    spread = lists.groupBy("bucket").applyInPandas(lambda p: _lookup(p, numbers, places), SPREAD)
    united = _united(docs, places)
    spread = spread if united is None else spread.unionByName(united)
    found = materialize(spread.groupBy("part").applyInPandas(_documents, DOCS), "join-documents", batch_rows=TEXT_ROWS)

    may = found.where("shingles is not null")
    classes = materialize(may.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "join-classes")
    members = attach(may.select("doc_id", "a", "b"), classes, ["a", "b"], classes.count(), BROADCAST_CLASSES, ["doc_id"]).select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    members = materialize(members, "join-members")
    copies = members.where("rep != doc_id").select("doc_id")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    reps = materialize(may.join(copies, "doc_id", "left_anti").select("doc_id", "n", "shingles"), "join-reps")

    heavy = HEAVY
    lists = reps.mapInPandas(lambda b: _again(b, keys, heavy), POSTINGS).groupBy("bucket").applyInPandas(lambda p: _lookup(p, numbers, places), SPREAD)
    first = materialize(lists.groupBy("part").applyInPandas(_prefixes, "doc_id long, shingle long"), "join-prefixes", batch_rows=TEXT_ROWS)
    stars = materialize(first.groupBy("shingle").agg(F.min("doc_id").alias("a"), F.count("*").alias("_k")).where("_k > 1"), "join-stars")
    near = components(meet(first, stars, "shingle").where("doc_id != a").select("a", F.col("doc_id").alias("b")))
    return found, members, _blocks(reps, near)


def _join(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The result, and the doc_ids of several rows."""
    found, members, blocks = _candidates(docs, buckets)
    links = materialize(blocks.groupBy("_block").applyInPandas(_search, LINKS), "join-links")
    joined = components(links.select("a", "b")).select(F.col("id").alias("rep"), "component")
    degrees = links.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("n_links"))
    named = members.join(degrees, "rep", "left").join(joined, "rep", "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = materialize(named.where("component != doc_id or n_links > 0"), "join-result")
    own = lambda c: F.coalesce(c, "doc_id")
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(linked, "doc_id", "left").select("doc_id", "n_shingles", own("component").alias("component_id"), own("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = F.lit(None).cast("long")
    nameless = docs.where(F.col("doc_id").isNull()).select(none.alias("doc_id"), _set_size(F.col("text")).alias("n_shingles"), none.alias("component_id"), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless), found.where("rows > 1").select("doc_id")


def _set_size(text):
    """n_shingles in SQL functions, for rows without doc_id."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")
    many = F.transform(F.array(words), lambda w: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (N - 1)), lambda i: F.slice(w, i, F.lit(N))))))[0]
    return F.when(F.size(words) >= N, many).when(F.size(words) > 0, 1).otherwise(0).cast("long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is the smallest of its component, one row each (of several with
    one doc_id the least by text, then the other columns that can be ordered); and all rows without doc_id."""
    result, repeated = _join(docs)
    gone = materialize(result.where("component_id != doc_id").select("doc_id"), "join-gone")
    more = materialize(repeated, "join-repeated")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if more.isEmpty():
        return left
    sortable = [f.name for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row, order = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct("text", *(F.col(f"`{c}`") for c in sortable))
    once = left.join(small(more), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return left.join(small(more), "doc_id", "left_anti").select(*docs.columns).unionByName(once)
