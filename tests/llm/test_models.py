"""Toxicity, decontamination, the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ragloom.llm import decontaminate, line_dedup, mixing, quality, queries, toxicity
from ragloom.llm.words import lcs_bits
from tests.llm.test_native import drop
from tests.llm.test_ngram_join import brute


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng)
    x = rng.standard_normal((5, 3, 3 * toxicity.DIM)).astype(np.float64)
    mask = np.ones((5, 3), np.float64)
    mask[3:, 1] = 0
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    real = model.states
    g, dx, loss = model.gradients(x, mask, y, w)
    assert real is not None
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = model.gradients(x, mask, y, w)[2]
            flat[i] = old - 1e-3
            down = model.gradients(x, mask, y, w)[2]
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def _toxic(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiolnrst") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(common) if rng.random() < 0.7 else word() for _ in range(rng.randint(5, 150))]
        bad = rng.random() < 0.3
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vilest", "zorg" + word(), "Wretch!"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = _toxic(900)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(9000, None, 0.0, ""), (9001, "", 0.0, ""), (9002, " \n", 0.0, ""), (None, "some words", 0.0, ""), (9003, "vilest " + "calm " * 30_000, 0.0, "")], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 905
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.93
    assert [got[i]["score"] for i in (9000, 9001, 9002)] == [0, 0, 0] and got[9003]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    rows = _toxic(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    a = toxicity.sample(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.sample(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, y in rows], "doc_id long, toxic int"))
    assert a == b and len(a[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))


def test_sample_takes_long_texts_whole_until_it_is_full(spark, monkeypatch):
    rows = [(i, ("w%d " % i) * (30_000 if i % 2 else 10)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i, _ in rows], "doc_id long, toxic boolean").selectExpr("doc_id", "int(toxic) as toxic")
    texts, _ = toxicity.sample(docs, labels)
    assert set(texts) == {t for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200_000)
    fewer, y = toxicity.sample(docs, labels)
    assert set(fewer) < set(texts) and {0, 1} == set(y) and max(map(len, fewer)) > 20_000


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("doc_id > 5"), labels.where("doc_id > 5")).count() == 0


def test_windows_cover_all_words():
    from ragloom.llm.words import pieces

    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        piece = next(pieces(["w " * n], toxicity.SEPARATORS))
        lo, k, _ = toxicity._windows(piece)
        assert {j for a, b in zip(lo, k, strict=True) for j in range(a, a + b)} == set(range(n)) and all(b - a == toxicity.STRIDE for a, b in zip(lo, lo[1:], strict=False))


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_bit_parallel_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 90))] for _ in "ab")
        assert lcs_bits(a, b) == lcs(a, b)


def _bench(rng):
    word = lambda: "".join(rng.choice("aeiolnrst") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(50)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    return text, [(i, f"{text(rng.randint(12, 40))}. {text(12)}.") for i in range(30)]


def test_leaks_found_and_clean_left_alone(spark):
    rng = random.Random(9)
    text, items = _bench(rng)
    docs, want = [], set()
    for i in range(400):
        body = text(rng.randint(20, 400)).split()
        k = rng.randrange(30)
        w = items[k][1].split()
        at = rng.randrange(len(body))
        if i % 4 == 0:  # copied, in other case and with other punctuation
            body[at:at] = [x.upper().replace(".", ";") for x in w]
            want.add((i, k))
        elif i % 4 == 1:  # paraphrased: a quarter of the words before the answer replaced
            first = len(w) - 12
            body[at:at] = [x if j >= first or j % 4 else text(1) for j, x in enumerate(w)]
            want.add((i, k))
        elif i % 4 == 2:  # only a third of the item
            body[at:at] = w[: len(w) // 3]
        docs.append((i, " ".join(body)))
    rows = [(*d, "x", 0.1) for d in docs] + [(1000, None, "", 0.0), (1001, "", "", 0.0), (None, items[3][1], "", 0.0), (1002, "pad " * 100_000 + items[4][1], "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, cosine double")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert found == want | {(None, 3), (1002, 4)}
    assert sorted(r["doc_id"] or -1 for r in decontaminate.keep_clean(df, bench).collect()) == sorted([-1, 1000, 1001, *(i for i in range(400) if i % 4 > 1)])


def test_item_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(10)
    text, items = _bench(rng)
    df = spark.createDataFrame([(k, text(50) + " " + t + " " + text(50)) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in ("BENCHMARK_CHARS", "BENCHMARK_WORDS"):
        monkeypatch.setattr(decontaminate, bound, 100)
        with pytest.raises(ValueError):
            decontaminate.leaks(df, bench)
        monkeypatch.undo()
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert {(r[0], r[1]) for r in decontaminate.leaks(df, bench).collect()} == {(k, k) for k, _ in items}
    assert decontaminate.leaks(df.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.leaks(df, bench.where("item_id < 0")).count() == 0 and decontaminate.keep_clean(df, bench.where("item_id < 0")).count() == 30


def test_latent_space_decides_and_rows_repeat(spark):
    rng = random.Random(12)
    text, items = _bench(rng)
    rows = [(1 if k % 3 else None, text(60) + " " + t + " " + text(60)) for k, t in items] + [(2, text(300)) for _ in range(300)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found) == sorted((1 if k % 3 else 0, k) for k, _ in items)
    words = [w.split() for _, w in items]
    flat = np.unique(np.concatenate([decontaminate.Items(items).rows[k][1] for k in range(30)]))
    assert len(flat) > 100 and len(words) == 30
    at = lambda rank: {(r["doc_id"], r["item_id"]): round(r["cosine"], 3) for r in decontaminate.leaks(df, bench, rank=rank, cosine=-1.0).collect()}
    assert at(1) != at(decontaminate.RANK)


def test_singular_vectors_equal_numpy():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 40))  # rank 6
    a[:, 7] = 0
    omega = rng.standard_normal((40, 16))
    places = decontaminate.latent(omega, a.T @ a @ omega, 6)
    v, s = np.linalg.svd(a, full_matrices=False)[2][:6].T, np.linalg.svd(a)[1][:6]
    want = v / s
    want /= np.maximum(np.linalg.norm(want, axis=1), 1e-12)[:, None]
    want[7] = 0
    assert np.allclose(places @ places.T, want @ want.T, atol=1e-3)  # equal up to a rotation


def test_longer_stretch_beside_a_denser_one():
    item = list(range(100, 140))
    scrambled = item[::-1]
    region = np.array(scrambled + [0] * 60 + [x if i % 5 else 1 for i, x in enumerate(item)], np.uint32)
    share, got, kind = decontaminate._settle(item, 10, region)
    assert kind == "copy" and share == 0.8


def test_short_and_long_items(spark):
    rng = random.Random(13)
    text, _ = _bench(rng)
    tiny, huge = "zorgle blip wumpus", text(700)
    words = huge.split()
    rows = [(1, text(50) + " Zorgle, blip: wumpus " + text(50)), (2, text(50) + " zorgle blip and wumpus " + text(50)), (3, text(40) + " " + huge + " " + text(40)), (4, " ".join(words[:200])), (5, tiny)]
    out = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, tiny), (1, huge)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 0), (5, 0), (3, 1)}


def all_leaks(texts, items):
    """By every stretch of every text: the ids of texts that leak an item."""
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), t))
    out = set()
    for t in items:
        w = words(t)
        sentences = [x for x in re.split(r"[.!?।]+", t) if x.strip()]
        answer = min(len(w), len(words(sentences[-1]))) if len(sentences) > 1 else max(1, len(w) // 3)
        bag, reach = set(w), max(len(w) + 16, len(w) * 3 // 2)
        for i, text in texts.items():
            x = words(text or "")
            if i not in out and len(bag.intersection(x)) >= 0.3 * len(bag):
                for a in range(max(len(x) - reach, 0) + 1):
                    part = x[a : a + reach]
                    if sum(y in bag for y in part) >= 0.55 * len(w) and (share := lcs(w, part) / len(w)) >= 0.55:
                        if share >= 0.75 or lcs(w[-answer:], part) / answer >= 0.8:
                            out.add(i)
                            break
    return out


def test_pipeline_against_plain_python(spark, sf_dir):
    """Each stage's rows, exactly; the first stage's estimates are held against numpy elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = sorted(r["doc_id"] for r in quality.score(docs).where("kept").collect())
    text = {i: x[0] for i, x in zip(ids, drop([(rows[i]["source"], rows[i]["text"]) for i in ids], line_dedup.RATIO), strict=True)}
    first = {i: c for i, (_, c) in brute(list(text.items())).items()}
    single = {i: t for i, t in text.items() if first[i] == i}
    gone = all_leaks(single, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    want = [set(ids), set(ids), set(single), set(single) - gone]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r["doc_id"] for r in docs.collect()} == expected, name
        if name != "quality_rules":
            assert all(r["text"] == text[r["doc_id"]] for r in docs.collect()), name
    assert gone and len(single) < len(ids)
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(mixing.mix(docs).collect())


def test_pipeline_on_odd_rows(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id double"
    rows = [(1, None, None, None, None, "a", 0.0), (2, "", "en", "s", 0, "b", 0.0), (3, "word " * 40, "en", "s", 200, "c", 0.0), (3, "word " * 40, "en", "s", 200, "c", 0.0), (None, " ".join(f"w{i}" for i in range(60)), "en", None, 5, None, None), (4, " ".join(f"v{i}" for i in range(60)), "en", "t", 5, None, None)]
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, cols).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "odd"))
        assert out.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} == {None, 4}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_every_operator_is_registered():
    assert [f"op{i}_" for i in range(1, 11)] == [n[: n.index("_") + 1] for n in queries.QUERIES if n.startswith("op")]
    assert "pipeline" in queries.QUERIES
