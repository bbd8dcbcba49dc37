"""Quality rules and line dedup."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest

from ragloom.llm import line_dedup, quality, queries

SPACE = "\x20\x09-\x0d"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, by loops."""
    w = re.findall(f"[^{SPACE}]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{SPACE}]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 30, "#*|<> x\nx\nx\n\nx y", "héé 𝔘 ñ", "x\x0by\x0cz\x1cq\x85r\u2003s"]
    for _ in range(60):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            w = w + w[i : i + rng.randint(1, 20)]
        out.append("".join(x + rng.choice([" ", " ", "\n", "  "]) for x in w))
    return out


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.score(df).collect()}
    for i, t in rows:
        want = base(t)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == want, t
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def stats(text):
    w, marks = re.findall(f"[^{SPACE}]+", text), sum(unicodedata.category(c)[0] in "PS" for c in text)
    n, chars = len(w), sum(map(len, w))
    return [math.log(n + 1), math.log((chars + 250) / (n + 50)), math.sqrt((marks + 7.5) / (chars + 250)), math.log(len(set(w)) + 1) / math.log(n + 2), math.sqrt((sum(len(x) < 4 for x in w) + 50 / 3) / (n + 50))]


def chi_square(k, seed=0):
    return np.sort((np.random.default_rng(seed).standard_normal((400_000, k)) ** 2).sum(1))


def textbook(x, share=0.75):
    """Minimum covariance determinant over many random starts, reweighted; chi-square by drawing it."""
    rng, five, seven = np.random.default_rng(3), chi_square(5), chi_square(7, 1)
    at = lambda q: five[int(q * len(five))]
    grow = lambda q: q / np.mean(seven <= at(q))
    dist = lambda m, c: np.einsum("ij,ij->i", np.linalg.solve(c, (x - m).T).T, x - m)
    h, best = math.ceil(share * len(x)), (np.inf,)
    for _ in range(60):
        rows = x[rng.choice(len(x), 12, replace=False)]
        det = np.inf
        while True:
            m, c = rows.mean(0), np.cov(rows.T, bias=True)
            if len(rows) == h and np.linalg.det(c) >= det * (1 - 1e-9):
                break
            det = np.linalg.det(c) if len(rows) == h else np.inf
            rows = x[np.argsort(dist(m, c))[:h]]
        if det < best[0]:
            best = det, m, c
    rows = x[dist(best[1], best[2] * grow(share)) <= at(0.975)]
    return dist(rows.mean(0), np.cov(rows.T, bias=True) * grow(0.975))


def page(rng, junk=False):
    w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 300))]
    return " ".join(x + "%%%" if junk else x for x in w)


def test_chi_square():
    assert quality.quantile(0.975) == pytest.approx(12.8325, abs=1e-3) and quality.quantile(0.99999) == pytest.approx(30.856, abs=1e-2)
    assert quality.consistency(0.75) == pytest.approx(0.75 / np.mean(chi_square(7) <= quality.quantile(0.75)), rel=0.01)


def test_estimate_equals_the_textbook_and_junk_goes(spark, monkeypatch):
    """Without the prior, which a textbook has not."""
    monkeypatch.setattr(quality, "PRIOR_DOCS", 1e-9)
    rng = random.Random(5)
    known = [page(rng).split()[0] + rng.choice(["", "", "", ","]) for _ in range(150)]
    prose = lambda: " ".join(rng.choice(known) for _ in range(int(rng.lognormvariate(5, 0.6)) + 25))
    rows = [(i, page(rng, True) if i % 10 == 0 else prose(), "en" if i % 3 else "de", "s") for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.score(df).collect()}
    for lang in ("en", "de"):
        ids = [r[0] for r in rows if r[2] == lang]
        want = textbook(np.array([stats(rows[i][1]) for i in ids]))
        have = np.array([got[i]["distance2"] for i in ids])
        clean = np.array([i % 10 != 0 for i in ids])
        assert np.corrcoef(have[clean], want[clean])[0, 1] > 0.995
        assert 0.97 < np.median(have[clean] / want[clean]) < 1.03
        assert ((have > quality.CUTOFF) == (want > quality.CUTOFF))[(want < 0.8 * quality.CUTOFF) | (want > 1.25 * quality.CUTOFF)].all()
    assert not any(got[i]["kept"] for i in range(0, 2100, 10))
    assert sum(got[i]["kept"] for i in range(2100) if i % 10) >= 1890 * 0.98
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(2100) if got[i]["kept"]]


def test_constant_statistics_and_groups_of_copies(spark):
    rng = random.Random(2)
    same = page(rng)
    rows = [(i, same, "en", "copies") for i in range(60)] + [(100 + i, page(rng), "en", "other") for i in range(60)] + [(200, page(rng, True), "en", "copies")]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(math.isfinite(r["distance2"]) for r in got.values())
    assert all(got[i]["kept"] for i in range(60)) and not got[200]["kept"]


def test_groups_without_broadcast_nulls_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i if i else None, page(rng, i % 9 == 0), None if i % 2 else "en", None, 1, True) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    want = sorted(map(repr, quality.score(df).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert sorted(map(repr, quality.score(df).collect())) == want
    assert quality.keep_good(df).where("doc_id IS NULL").count() == 1  # a row without doc_id stays


def test_lone_documents_are_kept_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "word " + page(random.Random(i), i == 0), "en", f"s{i}") for i in range(9)], "doc_id long, text string, lang string, source string")
    assert quality.score(df).where("kept").count() == 9
    assert quality.score(df.where("doc_id > 99")).count() == 0 and quality.keep_good(df.where("doc_id > 99")).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + " ".join(f"w{i}" for i in range(9))
    r = quality.score(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (200_009, 18)


def drop(rows, ratio):
    """Line dedup by loops; rows: (host, text)."""
    wordy = lambda x: re.search(f"[^{SPACE}]", x)
    pages, has = {}, {}
    for h, t in {(h, t) for h, t in rows if t is not None}:
        pages[h] = pages.get(h, 0) + 1
        for x in {x for x in t.split("\n") if wordy(x)}:
            has[h, x] = has.get((h, x), 0) + 1
    out = []
    for h, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (wordy(x) and has[h, x] > 1 and has[h, x] > ratio * pages[h])]
        out.append((t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_equal_a_loop(spark, monkeypatch):
    rng = random.Random(8)
    pool = ["menu", "footer text", "", " ", "ünïcode line"] + [f"only {i} is here with more words" for i in range(400)]
    rows = [(rng.choice(["a", "b", None]), None if i % 17 == 0 else "\n".join(rng.choice(pool[:5] if rng.random() < 0.3 else pool) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows += rows[:20] + [("c", "alone\non its host"), ("a", "menu\n" * 30_000)]
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, source string, text string, lines string, _host int")
    for ratio in (0.02, 0.05, 0.4):
        want = drop(rows, ratio)
        for most in (200_000, 0):
            monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
            got = {r["doc_id"]: r for r in line_dedup.drop_lines(df.drop("_host"), ratio=ratio).collect()}
            assert [(got[i]["text"], got[i]["_n_lines"], got[i]["_n_dropped"]) for i in range(len(rows))] == want
        assert any(w[2] for w in want)


def test_a_frequency_equal_to_the_ratio_stays(spark):
    rows = [(i, "s", f"own {i}" + "\nfive" * (i < 5) + "\nsix" * (i < 6)) for i in range(100)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), ratio=0.05)
    assert out.where("text like '%five%'").count() == 5 and out.where("text like '%six%'").count() == 0


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(i, "s", f"menu\nbody of page {i} {'x' * 30}", 3, "z") for i in range(300)], "doc_id long, source string, text string, n_chars long, _lines string")
    out = line_dedup.clean(df)
    assert out.columns == df.columns
    r = out.where("doc_id = 7").first()
    assert r["text"] == f"body of page 7 {'x' * 30}" and r["n_chars"] == len(r["text"]) and r["_lines"] == "z"
    assert line_dedup.clean(df.where("doc_id < 0")).count() == 0


def test_copies_are_kept_whole(spark):
    df = spark.createDataFrame([(i, "s", "the same\npage again", 3) for i in range(50)], "doc_id long, source string, text string, n_chars long")
    assert {r["text"] for r in line_dedup.clean(df).collect()} == {"the same\npage again"}


def test_line_dedup_equals_sql(same):
    same(queries.QUERIES["op9_line_dedup"], queries.ORACLE["op9_line_dedup"])


def test_native_plans_have_no_python(spark, sf_dir):
    for name in ("op1_quality_rules", "op9_line_dedup"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
