import collections
import random
import re

import numpy as np
import pytest

from ragloom.llm import ngram_join as nj
from ragloom.llm import queries


def shingle_sets(rows):
    sets = {}
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def linked(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def classes(sets):
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(frozenset(sets[i]), i)
    return {i: first.get(frozenset(s), i) for i, s in sets.items()}


def brute(rows):
    """doc_id -> (n, component), all pairs."""
    sets = shingle_sets(rows)
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def links(rows):
    """Links between classes: (a, b) -> overlap."""
    sets = shingle_sets(rows)
    reps = sorted(set(classes(sets).values()))
    return {(a, b): len(sets[a] & sets[b]) for a in reps for b in reps if a < b and linked(sets[a], sets[b])}


def check_links(spark, rows):
    df, sets, want = spark.createDataFrame(rows, "doc_id long, text string"), shingle_sets(rows), links(rows)
    of = classes(sets)
    degree = collections.Counter(i for pair in want for i in pair)
    got = {r["doc_id"]: r for r in nj.join(df).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (of[i], degree[of[i]]) for i in sets}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(rows)
    assert {(r["a"], r["b"]): r["overlap"] for r in nj.pairs(df).collect()} == want
    return want


def corpus(seed, n=140):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [word() for _ in range(60)]
    out, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and bases:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            out.append((i, (" " if rng.random() < 0.8 else "\n\t").join(w).swapcase() if rng.random() < 0.2 else " ".join(w)))
        else:
            w = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 120]))]
            w = w + shared if rng.random() < 0.4 else w
            bases.append(w)
            out.append((i, " ".join(w)))
    return out


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.join(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, None)]
    assert len(check_links(spark, rows)) > 20


def test_small_tasks_and_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(7)
    # Tasks run in workers of their own, where only what the closure carries is seen; the block size is the driver's.
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(nj, "HEAVY", 3)
    monkeypatch.setattr(nj, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(nj, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(nj, "BROADCAST_IDS", 0)
    check_links(spark, rows)


def test_rows_of_one_id_are_united(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, three = text(104), text(104), text(60)
    rows = [(1, one), (1, two), (2, one), (3, one + " " + two), (4, three), (4, three), (5, three), (6, one), (6, one + " tail"), (7, None), (7, one)]
    check_links(spark, rows)
    got = {r["doc_id"]: r for r in nj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_shingles"] == 200 and got[2]["component_id"] == 2 and got[1]["component_id"] == 1 == got[3]["component_id"]


def test_merge_counts_by_heap_and_by_counting(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(rng.integers(1, 20))]
        want = collections.Counter(int(y) for x in lists for y in x if 10 <= y < 50)
        for most in (0, 10_000):
            monkeypatch.setattr(nj, "HEAP", most)
            found, counts = nj.merge_counts(lists, 10, 50)
            assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == want and (np.diff(found) > 0).all()


@pytest.mark.parametrize("probes", [0, 64])
def test_divide_skip_links_exactly(probes, monkeypatch):
    monkeypatch.setattr(nj, "PROBES", probes)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 + 3 * k], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in range(0, 33, 2)] + [np.unique(rng.choice(base, 200, replace=False)) for _ in range(30)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    side = rng.integers(0, 2, len(sets))
    for both in (True, False):
        got = {(x, int(y)): int(o) for x, ys, overlap in nj.divide_skip(n, sets, side, both) for y, o in zip(ys, overlap, strict=True)}
        common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a) if both or side[a] != side[b]}
        assert got == {(a, b): i for (a, b), i in common.items() if 100 * i >= 80 * (n[a] + n[b] - i)} and got


def test_hot_keys_are_broadcast(spark):
    from ragloom.llm.skew import meet

    rows = spark.createDataFrame([(k % 3, k) for k in range(300)] + [(9, 1), (10, 2)], "k long, v long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "_k").where("k != 10")
    for hot in (10, 100_000):
        assert sorted(meet(rows, keyed, "k", hot).collect()) == sorted(rows.where("k != 10").collect())


def test_hot_group_and_long_text(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base) for i in range(400)] + [(1000 + i, base + f" tail{i}") for i in range(200)] + [(5000, " ".join(f"x{i}" for i in range(150_000)))]
    got = joined(spark, rows)
    assert {got[i][1] for i in got if i < 5000} == {0} and got[5000] == (149_996, 5000)


def test_null_ids_repeated_rows_and_columns(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text, 1, 2), (1, text, 3, 4), (2, text, 0, 0), (None, text, 0, 0), (None, "A B", 0, 0)], "doc_id long, text string, n int, component long")
    got = collections.Counter((r[0], r[1], r[2]) for r in nj.join(df).collect())
    assert got == {(1, 4, 1): 1, (2, 4, 1): 1, (None, 4, None): 1, (None, 1, None): 1}
    assert sorted((r["doc_id"] or -1, r["n"]) for r in nj.keep_one(df).collect()) == [(-1, 0), (-1, 0), (1, 1)]


def test_empty_table(spark):
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equals_sql(same):
    same(queries.QUERIES["op2_ngram_join"], queries.ORACLE["op2_ngram_join"])
