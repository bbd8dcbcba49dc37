"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Per document: word, symbol, repeated-line and repeated-window counts; from its
words five transformed statistics that scatter in every language: x0 log of the
words, x1 log of letters a word, x2 root of the share of punctuation and
symbols, x3 log of different words over log of words, x4 root of the share of
words of up to three letters. Rates are shrunk by ``PRIOR_WORDS`` words, so that
short texts do not scatter more. Per group (language, source) a minimum
covariance determinant estimate of their centre and scatter; a document whose
squared Mahalanobis distance exceeds ``CUTOFF``, the ``QUANTILE`` of chi-square
with 5 degrees of freedom, is rejected.

How the estimate is found without gathering a group anywhere. Four starts:
median and inter-quartile ranges (from counts on a fixed grid), mean and
covariance, the covariance of spatial signs and that of tanh scores about the
median. A concentration step aggregates the moments of each group and start by
bins of the current distance (at most ``D2_BINS`` rows leave a task, whatever the
group's size), sums the bins outwards until they hold the ``H_SHARE`` nearest
documents (of the last bin the part that is still needed) and takes centre and
scatter of those, with the consistency factor of that share. Steps go on until
no determinant falls by ``TOLERANCE``; of a group's starts the one with the
smallest determinant stays. It is reweighted by all documents within
``REWEIGHT``, with that quantile's factor.

Scatters are regularised (minimum regularised covariance determinant): a group
of n documents takes the share ``PRIOR_DOCS`` / (n + ``PRIOR_DOCS``) from the
variances of its language, which take theirs from all documents in like manner.
So a group of a few documents is judged by its language's spread, with no limit
of size. The variance of rounding to a grid's cell is added to each diagonal,
far below any spread; it matters only to groups in which a statistic is
constant.

Defined cases: null text has no words (all counts 0, base rule fails); null
language or source form groups of their own; a document alone in its group is
its own centre and kept; rows that repeat are judged one by one, alike; of
starts with one determinant the first stays; a distance equal to the cutoff is
kept; a very long text is counted whole, in memory that grows with it; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragloom.llm.scratch import materialize
from ragloom.llm.skew import attach

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, REPEAT_PERCENT, WINDOW_WORDS = 20, 30, 8
PRIOR_WORDS = 50.0
#: Cells of the grid by which quartiles are counted, in each statistic's units.
CELL = {"x0": 0.05, "x1": 0.004, "x2": 0.004, "x3": 0.001, "x4": 0.005}
NAMES = list(CELL)
P = len(NAMES)
H_SHARE, PRIOR_DOCS, TOLERANCE, MOST_STEPS = 0.75, 10.0, 1e-3, 60
QUANTILE, REWEIGHT_SHARE = 0.99999, 0.975
D2_BINS, PER_OCTAVE = 800, 16
#: Groups whose estimates are sent to every executor (about 250 bytes each); beyond, a salted join.
BROADCAST_GROUPS = 20_000


def chi2(x: float, p: int) -> float:
    """Chi-square's distribution function, p odd."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, p, 2):
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def quantile(share: float, p: int = P) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2(mid, p) < share else (low, mid)
    return high


def consistency(share: float, p: int = P) -> float:
    """What the covariance of the nearest share of normal data must be multiplied by."""
    return share / chi2(quantile(share, p), p + 2)


CUTOFF, REWEIGHT = quantile(QUANTILE), quantile(REWEIGHT_SHARE)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words under windows that begin at these ascending positions."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: F.least(F.lit(WINDOW_WORDS), F.get(starts, k) - F.get(starts, k - 1)))
    return F.lit(WINDOW_WORDS) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeated_starts(ordered: Column) -> Column:
    """Positions of windows that occur twice or more; ordered: (hash, position), sorted."""
    same = lambda k, other: F.get(ordered, k)["h"].eqNullSafe(F.get(ordered, other)["h"])
    at = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.when(same(k, k + 1) | ((k > 0) & same(k, k - 1)), F.get(ordered, k)["i"]))
    return F.sort_array(F.array_compact(at))


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW_WORDS))))
    slow = lambda h: _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: _let(_repeated_starts(s), _covered))
    many = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), slow(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW_WORDS, many).otherwise(F.lit(0))


def with_counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The carried columns, the base counts, base_failed and the transformed statistics x0..x4."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).alias("different"),
        F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"),
    )
    counted = docs.select(
        *carry,
        _let(words, of_words).alias("_w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[\p{P}\p{S}]")).alias("_marks"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    return counted.select(
        *carry, F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.n_repeat_words").alias("n_repeat_words"), "_w", "_marks",
    ).select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * n)).alias("base_failed"),
        F.log1p(n.cast("double")).alias("x0"),
        F.log((chars + PRIOR_WORDS * 5) / (n + PRIOR_WORDS)).alias("x1"),
        F.sqrt((F.col("_marks") + PRIOR_WORDS * 0.15) / (chars + PRIOR_WORDS * 5)).alias("x2"),
        (F.log(F.col("_w.different") + F.lit(1.0)) / F.log(n + F.lit(2.0))).alias("x3"),
        F.sqrt((F.col("_w.short") + PRIOR_WORDS / 3) / (n + PRIOR_WORDS)).alias("x4"),
    )


KEYS = ["_l", "_s"]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
CENTRE, FACTOR = [f"m{i}" for i in range(P)], [f"l{i}{j}" for i, j in PAIRS]
SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]


def _attach(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    return attach(rows, groups, keys, n_groups, BROADCAST_GROUPS, ["doc_id", "n_words", "word_chars"])


def _d2(rows: DataFrame) -> DataFrame:
    """Squared distance by forward substitution with the Cholesky factor l_ij and centre m_i."""
    done: list[str] = []
    for i, x in enumerate(NAMES):
        z = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        done.append(f"z{i}")
    return rows.withColumn("d2", sum((F.col(z) * F.col(z) for z in done), F.lit(0.0))).drop(*done)


def _moments(vector: list[Column]) -> list[Column]:
    return [F.sum(v).alias(f"s{i}") for i, v in enumerate(vector)] + [F.sum(vector[i] * vector[j]).alias(f"q{i}{j}") for i, j in PAIRS]


def _factored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, m0..m4, the Cholesky factor of v_ij regularised by the group's share rho and prior variances t_i, and logdet."""
    out = rows
    for i, j in PAIRS:
        v = F.col(f"v{i}{j}") * (1 - F.col("rho"))
        if i == j:
            v = F.greatest(v, F.lit(0.0)) + F.col("rho") * F.col(f"t{i}") + F.lit(CELL[NAMES[i]] ** 2 / 12)
        for a in range(j):
            v = v - F.col(f"l{i}{a}") * F.col(f"l{j}{a}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(CELL[NAMES[i]] ** 2 / 12))) if i == j else v / F.col(f"l{j}{j}"))
    return out.select(*keep, *CENTRE, *FACTOR, sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("logdet"))


def _covariance(sums: DataFrame, factor: float) -> DataFrame:
    """m_i and v_ij = factor * covariance beside the sums k, s_i, q_ij."""
    out = sums.select("*", *((F.col(f"s{i}") / F.col("k")).alias(f"m{i}") for i in range(P)))
    return out.select("*", *(((F.col(f"q{i}{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(f"v{i}{j}") for i, j in PAIRS))


def _quartiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, and of each statistic the median c_i and the variance r_i by the inter-quartile range; cells: keys, i, b, count."""
    counts = cells.groupBy(*keys, "i", "b").agg(F.sum("count").alias("count"))
    upto, whole = W.partitionBy(*keys, "i").orderBy("b"), W.partitionBy(*keys, "i")
    cum = counts.withColumn("c", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(whole))
    at = lambda q: F.min(F.when(F.col("c") >= F.col("n") * q, F.col("b")))
    quart = cum.groupBy(*keys, "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("n").alias("n"))
    of = lambda i, v: F.max(F.when(F.col("i") == i, v))
    return quart.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *(of(i, (F.col("mid") + 0.5) * CELL[x]).alias(f"c{i}") for i, x in enumerate(NAMES)),
        *(of(i, F.pow((F.col("high") - F.col("low")) * CELL[x] / 1.349, 2)).alias(f"r{i}") for i, x in enumerate(NAMES)),
    )


def _priors(good: DataFrame) -> DataFrame:
    """A row per group: rho, the prior variances t_i of its language, its medians c_i and deviations d_i."""
    tall = good.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) / CELL[x]).alias("b")) for i, x in enumerate(NAMES)))).alias("v")).select(*KEYS, "v.i", "v.b")
    cells = materialize(tall.groupBy(*KEYS, "i", "b").count(), "quality-cells")
    every = cells.withColumn("_all", F.lit(0))
    overall = _quartiles(every, ["_all"]).select(*(F.col(f"r{i}").alias(f"o{i}") for i in range(P)))  # one row
    share = F.lit(PRIOR_DOCS) / (F.col("n") + PRIOR_DOCS)
    mixed = lambda own, prior: (1 - share) * F.col(own) + share * F.col(prior)
    language = _quartiles(cells, ["_l"]).join(F.broadcast(overall)).select("_l", *(mixed(f"r{i}", f"o{i}").alias(f"t{i}") for i in range(P)))
    return _quartiles(cells, KEYS).join(language, "_l").select(
        *KEYS, share.alias("rho"), *(f"t{i}" for i in range(P)), *(f"c{i}" for i in range(P)),
        *(F.sqrt(mixed(f"r{i}", f"t{i}") + CELL[x] ** 2 / 12).alias(f"d{i}") for i, x in enumerate(NAMES)),
    )


PRIOR_COLUMNS = ["rho", *(f"t{i}" for i in range(P))]


def _starts(good: DataFrame, priors: DataFrame, n_groups: int) -> DataFrame:
    """Four first estimates a group: _start, m_i, l_ij, logdet (infinite)."""
    rows = _attach(good, priors.select(*KEYS, *(f"{a}{i}" for a in "cd" for i in range(P))), KEYS, n_groups)
    z = [(F.col(x) - F.col(f"c{i}")) / F.col(f"d{i}") for i, x in enumerate(NAMES)]
    rows = rows.select(*KEYS, *NAMES, *(v.alias(f"z{i}") for i, v in enumerate(z)))
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-9))
    kinds = [[F.col(x) for x in NAMES], [F.col(f"z{i}") / length for i in range(P)], [F.tanh(f"z{i}") for i in range(P)]]
    tall = rows.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(k + 1).alias("_start"), *(v.alias(f"y{i}") for i, v in enumerate(y))) for k, y in enumerate(kinds)))).alias("y")).select(*KEYS, "y.*")
    sums = tall.groupBy(*KEYS, "_start").agg(F.count("*").alias("k"), *_moments([F.col(f"y{i}") for i in range(P)])).join(priors, KEYS)
    plain = _covariance(sums, 1.0)
    about = lambda i, j: {1: F.col(f"v{i}{j}"), 2: P * F.col(f"q{i}{j}") / F.col("k") * F.col(f"d{i}") * F.col(f"d{j}"), 3: F.col(f"v{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}")}
    scores = plain.select(
        *KEYS, "_start", *PRIOR_COLUMNS,
        *(F.when(F.col("_start") == 1, F.col(f"m{i}")).otherwise(F.col(f"c{i}")).alias(f"m{i}") for i in range(P)),
        *(F.when(F.col("_start") == 1, about(i, j)[1]).when(F.col("_start") == 2, about(i, j)[2]).otherwise(about(i, j)[3]).alias(f"v{i}{j}") for i, j in PAIRS),
    )
    ranges = priors.select(*KEYS, F.lit(0).alias("_start"), *PRIOR_COLUMNS, *(F.col(f"c{i}").alias(f"m{i}") for i in range(P)), *((F.pow(f"d{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS))
    return _factored(ranges.unionByName(scores), [*KEYS, "_start"]).withColumn("logdet", F.lit(float("inf")))


def _concentrated(good: DataFrame, state: DataFrame, priors: DataFrame, n_groups: int) -> DataFrame:
    """One concentration step for every group and start in state."""
    by = [*KEYS, "_start"]
    near = _d2(_attach(good, state, KEYS, n_groups).where("_start is not null"))
    bins = near.groupBy(*by, F.least(F.lit(D2_BINS), F.floor(PER_OCTAVE * F.log2(1 + F.col("d2")))).alias("bin")).agg(F.count("*").alias("k"), *_moments([F.col(x) for x in NAMES]))
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("_c", F.sum("k").over(upto)).withColumn("_h", F.ceil(F.sum("k").over(W.partitionBy(*by)) * H_SHARE))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_h") - (F.col("_c") - F.col("k"))) / F.col("k")))
    sums = bins.where(F.col("_c") - F.col("k") < F.col("_h")).groupBy(*by).agg(*(F.sum(F.col(c) * part).alias(c) for c in ["k", *SUMS]))
    return _factored(_covariance(sums, consistency(H_SHARE)).join(priors.select(*KEYS, *PRIOR_COLUMNS), KEYS), by)


def estimates(good: DataFrame) -> tuple[DataFrame, int]:
    """A row per group of good (_l, _s, x0..x4): its reweighted centre and factor; and how many there are."""
    priors = materialize(_priors(good), "quality-priors")
    n_groups = priors.count()
    best = materialize(_starts(good, priors, n_groups).withColumn("_better", F.lit(True)), "quality-starts")
    for step in range(MOST_STEPS):
        new = _concentrated(good, best.where("_better").drop("_better"), priors, n_groups)
        both = best.drop("_better").join(new.select(*KEYS, "_start", F.struct(*CENTRE, *FACTOR, "logdet").alias("_new")), [*KEYS, "_start"], "left")
        better = F.coalesce(F.col("_new.logdet") < F.col("logdet") - TOLERANCE, F.lit(False))
        taken = (F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in [*CENTRE, *FACTOR, "logdet"])
        best = materialize(both.select(*KEYS, "_start", *taken, better.alias("_better")), f"quality-step{step}")
        if best.where("_better").isEmpty():
            break
    chosen = best.groupBy(*KEYS).agg(F.min_by(F.struct(*CENTRE, *FACTOR), F.struct("logdet", "_start")).alias("e")).select(*KEYS, "e.*")
    near = _d2(_attach(good, chosen, KEYS, n_groups)).where(F.col("d2") <= REWEIGHT)
    sums = near.groupBy(*KEYS).agg(F.count("*").alias("k"), *_moments([F.col(x) for x in NAMES]))
    return materialize(_factored(_covariance(sums, consistency(REWEIGHT_SHARE)).join(priors.select(*KEYS, *PRIOR_COLUMNS), KEYS), KEYS), "quality-estimates"), n_groups


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts, base_failed, kept, distance2 (null where the group has no row that passes the base rules)."""
    stats = materialize(with_counts(docs), "quality-stats")
    keyed = stats.withColumn("_l", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    groups, n_groups = estimates(keyed.where(~F.col("base_failed")))
    judged = _d2(_attach(keyed, groups, KEYS, n_groups))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
        F.col("d2").alias("distance2"),
    )


#: Rejected ids that are sent to every executor (8 bytes each); beyond, a shuffled anti join.
BROADCAST_IDS = 500_000


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is on no rejected row. A row without doc_id stays."""
    bad = materialize(score(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "quality-rejected")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
