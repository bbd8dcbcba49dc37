"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, in numpy.

Each text is cut into overlapping windows of ``LENGTH`` words, ``STRIDE``
apart. A word enters as a hashed word vector, the mean of its character
trigrams' vectors and the mean of its prefixes' vectors. A GRU runs over the
window in both directions; attention weights the states; a logistic unit
scores the pooled state. A text's score is its highest window's.

Training: on the driver, from at most ``SAMPLE`` labelled documents of each
class (those with the smallest hash of doc_id, in that order, until
``SAMPLE_CHARS`` characters of whole texts are in the sample of that class),
never from held-out rows (crc32 of doc_id as text, mod 5, is 0). Labels are of whole texts, so a toxic
text's training window is the one the model, at first the log odds of its
words, finds most toxic; texts that are not toxic give their most suspect
windows. Vectors start from log odds in the sample. Scoring covers all
windows of all texts; nothing but the text enters a score.

Defined cases: null, empty and word-less texts score 0; without labels of both
classes every text scores the share of the class there is; a row without
doc_id is not held out; rows that repeat score alike, of labels that differ for
one doc_id the higher counts, of its texts the shortest is learnt from; a very
long text is scored whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.words import SPACES, Piece, counts_of, mix, pieces

LENGTH, STRIDE = 48, 32
WORD_BITS, CHAR_BITS, DIM, HIDDEN = 17, 16, 4, 8
PREFIXES = (3, 4, 5, 6)
SAMPLE, SAMPLE_CHARS = 2000, 12_000_000
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 5
SUPPORT, PRIOR = 3, 4.0
#: Punctuation does not belong to a word here.
SEPARATORS = SPACES.copy()
SEPARATORS[[ord(c) for c in ".,;:!?\"'()[]{}|"]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inputs(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: word bucket, prefix buckets, trigram buckets and their edges; per word its distinct number."""
    _, first, inverse = np.unique(piece.hash, return_index=True, return_inverse=True)
    start, size = piece.start[first], (piece.end - piece.start)[first]
    word = (piece.hash[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    buf = np.concatenate([piece.buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    prefix, h = [], np.full(len(first), 1469598103934665603, np.uint64)
    for j in range(max(PREFIXES)):
        h = np.where(j < size, (h ^ buf[start + j]) * np.uint64(1099511628211), h)
        if j + 1 in PREFIXES:
            prefix.append((mix(h + np.uint64(j)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
    grams = np.maximum(size - 2, 1)
    at = np.repeat(start, grams) + counts_of(grams)
    code = buf[at] | buf[at + 1] << np.uint64(8) | buf[at + 2] << np.uint64(16)
    trigram = (mix(code + np.uint64(1 << 40)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    return word, np.stack(prefix, 1) if len(first) else np.zeros((0, len(PREFIXES)), np.int64), trigram, grams, inverse


def _windows(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each window."""
    n = np.diff(piece.of)
    count = np.where(n > 0, np.maximum(-(-(n - LENGTH) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    lo = piece.of[doc] + counts_of(count) * STRIDE
    return lo, np.minimum(lo + LENGTH, piece.of[doc + 1]) - lo, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    def __init__(self, rng: np.random.Generator):
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.word = (0.05 * rng.standard_normal((1 << WORD_BITS, DIM))).astype(np.float32)
        self.prefix = (0.05 * rng.standard_normal((1 << CHAR_BITS, DIM))).astype(np.float32)
        self.trigram = (0.05 * rng.standard_normal((1 << CHAR_BITS, DIM))).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("wx", w(3 * DIM, 3 * HIDDEN)), ("wh", 0.5 * w(HIDDEN, 3 * HIDDEN)), ("bx", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"u": 0.1 * w(2 * HIDDEN), "v": w(2 * HIDDEN), "b": np.zeros(1, np.float32)}

    def embed(self, word: np.ndarray, prefix: np.ndarray, trigram: np.ndarray, grams: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, 3 * DIM), np.float32)
        edge = np.cumsum(grams) - grams
        chars = np.add.reduceat(self.trigram[trigram], edge, axis=0) / grams[:, None]
        return np.concatenate([self.word[word], self.prefix[prefix].mean(axis=1), chars], axis=1).astype(np.float32)

    def states(self, proj: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """GRU states (time, window, HIDDEN); proj: (time, window, 3 HIDDEN), already in this direction's order."""
        wh, k = self.p["wh" + d], HIDDEN
        h = np.zeros((proj.shape[1], k), np.float32)
        out = np.empty((*proj.shape[:2], k), np.float32)
        for t in range(len(proj)):
            g, x, m = h @ wh, proj[t], mask[t][:, None]
            zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * k :]))
            h = out[t] = new
        return out

    def pooled(self, both: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = both @ self.p["u"] - 1e9 * (1 - mask)
        a = np.exp(a - a.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        return np.einsum("tw,twk->wk", a, both), a

    def logits(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """vectors: of distinct words; at, mask: (time, window)."""
        fwd = self.states((vectors @ self.p["wxf"] + self.p["bxf"])[at], mask, "f")
        bwd = self.states((vectors @ self.p["wxb"] + self.p["bxb"])[at[::-1]], mask[::-1], "b")[::-1]
        pooled, _ = self.pooled(np.concatenate([fwd, bwd], axis=2), mask)
        return pooled @ self.p["v"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Back-propagation through time; x: (time, window, 3 DIM). Gradients of p and of x, and the loss."""
        k, p = HIDDEN, self.p
        tapes, outs = {}, {}
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            tapes[d] = []
            outs[d] = self.states(x[order] @ p["wx" + d] + p["bx" + d], mask[order], d, tapes[d])[order]
        both = np.concatenate([outs["f"], outs["b"]], axis=2)
        pooled, a = self.pooled(both, mask)
        s = _sigmoid(pooled @ p["v"] + p["b"][0])
        loss = float(-(weight * (y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7))).sum())
        dl = (weight * (s - y)).astype(np.float32)
        g = {"v": pooled.T @ dl, "b": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["v"]
        da = np.einsum("wk,twk->tw", dp, both)
        da = a * (da - (a * da).sum(axis=0))
        g["u"] = np.einsum("tw,twk->k", da, both)
        dboth = a[:, :, None] * dp + da[:, :, None] * p["u"]
        dx = np.zeros_like(x)
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            dh_all, m_all, x_all = (dboth[:, :, :k] if d == "f" else dboth[:, :, k:])[order], mask[order], x[order]
            wh, wx = p["wh" + d], p["wx" + d]
            gwh, dproj, dh = np.zeros_like(wh), np.empty((*x.shape[:2], 3 * k), np.float32), np.zeros_like(dh_all[0])
            for t in range(len(x) - 1, -1, -1):
                h, z, r, n, gn = tapes[d][t]
                dh = dh + dh_all[t]
                m = m_all[t][:, None]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = -dh * m * (n - h) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gwh += h.T @ dg
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
                dh = dh * (1 - m * (1 - z)) + dg @ wh.T
            g |= {"wh" + d: gwh, "wx" + d: np.einsum("twi,twj->ij", x_all, dproj), "bx" + d: dproj.sum(axis=(0, 1))}
            dx[order] += dproj @ wx.T
        return g, dx, loss

    def score(self, texts) -> np.ndarray:
        """A score per text: its highest window's."""
        out = np.zeros(len(texts))
        for piece in pieces(texts, SEPARATORS):
            lo, n, doc = _windows(piece)
            if not len(lo):
                continue
            *parts, inverse = _inputs(piece)
            vectors = self.embed(*parts)
            best = np.full(len(piece), -np.inf)
            for a in range(0, len(lo), 4096):
                at, mask = _matrix(lo[a : a + 4096], n[a : a + 4096], inverse)
                np.maximum.at(best, doc[a : a + 4096], self.logits(vectors, at, mask))
            found = np.flatnonzero(best > -np.inf)
            out[piece.first + found] = _sigmoid(best[found])
        return out


def _matrix(lo: np.ndarray, n: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, and which of the places are words: (time, window)."""
    place = np.arange(int(n.max()))[:, None]
    mask = place < n
    return inverse[np.where(mask, lo + place, lo)], mask.astype(np.float32)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts) -> np.ndarray:
        return np.array([self.value if isinstance(t, str) and t.strip() else 0.0 for t in texts])


def _odds(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: log odds of the toxic class against the sample's, drawn towards it where few texts hold the bucket; and whether ``SUPPORT`` texts do."""
    seen = np.unique(doc * size + ids)
    d, i = seen // size, seen % size
    pos, n = np.bincount(i, weights=y[d], minlength=size), np.bincount(i, minlength=size)
    base = y.mean()
    rate = (pos + PRIOR * base) / (n + PRIOR)
    return np.clip(np.log(rate / (1 - rate)) - np.log(base / (1 - base)), -1.5, 6) / 3, n >= SUPPORT


def train(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS):
    """A model from labelled texts."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    model = Model(rng)
    piece = next(pieces(texts, SEPARATORS, most=1 << 62))
    word, prefix, trigram, grams, inverse = _inputs(piece)
    text_of = np.repeat(np.arange(len(texts)), np.diff(piece.of))
    # What fewer than SUPPORT texts hold says nothing of the next text: its vectors are 0 and stay so.
    odds, learn_word = _odds(word[inverse], text_of, y, 1 << WORD_BITS)
    model.word *= learn_word[:, None]
    model.word[:, 0] = odds * learn_word
    learn_prefix, odds_p = np.zeros(1 << CHAR_BITS, bool), np.zeros(1 << CHAR_BITS)
    for j in range(prefix.shape[1]):
        odds, enough = _odds(prefix[inverse, j], text_of, y, 1 << CHAR_BITS)
        odds_p[enough], learn_prefix = odds[enough], learn_prefix | enough
    model.prefix *= learn_prefix[:, None]
    model.prefix[:, 0] = odds_p
    lo, n, doc = _windows(piece)
    if not len(lo):
        return Constant(float(y.mean()))
    suspect = np.maximum(model.word[word, 0], model.prefix[prefix, 0].max(axis=1))[inverse]
    rank = np.array([suspect[a : a + k].max() for a, k in zip(lo, n, strict=True)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            vectors = model.embed(word, prefix, trigram, grams)
            rank = np.concatenate([model.logits(vectors, *_matrix(lo[a : a + 2048], n[a : a + 2048], inverse)) for a in range(0, len(lo), 2048)])
        order = np.lexsort((-rank, doc))
        first = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))
        top = order[first]
        other = rng.choice(len(lo), min(len(lo), 2 * len(top)), replace=False)
        chosen = np.unique(np.concatenate([top, other[y[doc[other]] == 0]]))
        target = y[doc[chosen]]
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
        shuffled = rng.permutation(len(chosen))
        for a in range(0, len(chosen), BATCH):
            part = shuffled[a : a + BATCH]
            w = chosen[part]
            at, mask = _matrix(lo[w], n[w], inverse)
            uniq, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            sel = np.concatenate([np.arange(c - g, c) for c, g in zip(np.cumsum(grams)[uniq], grams[uniq], strict=True)])
            x = model.embed(word[uniq], prefix[uniq], trigram[sel], grams[uniq])[local]
            g, dx, _ = model.gradients(x, mask, target[part], weight[part] * len(chosen) / len(part))
            step += 1
            for k, v in g.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                model.p[k] = (model.p[k] - RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            du = np.zeros((len(uniq), 3 * DIM))
            np.add.at(du, local.ravel(), (dx * mask[:, :, None]).reshape(-1, 3 * DIM))
            du = np.clip(du * 2, -0.2, 0.2).astype(np.float32)
            np.subtract.at(model.word, word[uniq], du[:, :DIM] * learn_word[word[uniq]][:, None])
            for j in range(prefix.shape[1]):
                np.subtract.at(model.prefix, prefix[uniq, j], du[:, DIM : 2 * DIM] / prefix.shape[1] * learn_prefix[prefix[uniq, j]][:, None])
            np.subtract.at(model.trigram, trigram[sel], np.repeat(du[:, 2 * DIM :] / grams[uniq][:, None], grams[uniq], axis=0))
    # The threshold between whole texts of the sample becomes 0.5.
    s = model.score(texts)
    z = np.sort(np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6))))
    cuts = (z[1:] + z[:-1]) / 2
    logit = np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))
    by = np.argsort(logit, kind="stable")
    right = np.cumsum((1 - y)[by])[:-1] / (1 - y).sum() + (y.sum() - np.cumsum(y[by])[:-1]) / y.sum()
    best = np.flatnonzero(right >= right.max() - 1e-9) if len(right) else []
    if len(best):
        widest = best[np.argmax((z[1:] - z[:-1])[best])]
        model.p["b"] = model.p["b"] - np.float32(cuts[widest])
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from, in a fixed order."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = [r for y in (1, 0) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not ids:
        return [], []
    listed = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["y"]), k) for k, r in enumerate(ids)], "doc_id long, y int, k int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(F.broadcast(listed), "doc_id").groupBy("doc_id", "y", "k").agg(F.min("n").alias("n")).orderBy("k").collect()  # of 2 SAMPLE documents at most
    held, whole = {0: 0, 1: 0}, []
    for r in sizes:
        if held[r["y"]] < SAMPLE_CHARS:
            held[r["y"]] += r["n"]
            whole.append((r["doc_id"], r["y"]))
    picked = F.broadcast(docs.sparkSession.createDataFrame(whole, "doc_id long, y int"))
    rows = texts.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["y"] for r in rows]


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")  # pandas keeps text whole beside nulls
    return named.mapInPandas(run, OUT.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(*sample(docs, labels)))
