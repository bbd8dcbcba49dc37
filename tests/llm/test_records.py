"""URL filter, WARC packages, token rollups, license scan, mixing."""

import collections
import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pytest

from ragloom.llm import licenses, mixing, queries, token_rollup, url_filter, warc_zip
from ragloom.llm.scratch import new_path
from ragloom.llm.words import lcs_bits

RULES = "action string, host string, path string"


def judged(rows, rules, default="allow"):
    out = []
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:cut], rest[cut:]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best and best[3], best[4] if best else default))
    return out


def test_urls_equal_a_loop(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "Com", "net", "x1"]) for _ in range(rng.randint(1, 5)))
    rows = [(i, rng.choice(["http", "https"]) + "://" + host() + rng.choice(["", "/", "/en/1", "/en/", "/de/88", "/EN", "?q=/en/", "#/en/"]) + rng.choice(["", "?x://y", "#z"])) for i in range(500)]
    rows += [(500, None), (501, "no scheme"), (502, "://"), (503, "x://\ny/é"), (None, "http://a.com/en/1"), *rows[:9]]
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/1"), ("block", "b.a.com", ""), ("allow", "net", "/de/"), ("block", "a.net", "/de/8"), ("block", "x1", "/"), ("allow", "x1", "/"), ("block", "com", ""), ("allow", "b.com", "/en/"), ("block", "a", "/d")]
    df = spark.createDataFrame([(i, u, "extra", 1) for i, u in rows], "page_id long, url string, host string, part int")
    got = [tuple(r) for r in url_filter.judge(df, spark.createDataFrame(rules, RULES)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, judged(rows, rules)))


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(none, spark.createDataFrame(queries.RULES, RULES)).count() == 0
    assert tuple(url_filter.judge(some, spark.createDataFrame([], RULES)).first()) == (1, "a.com", "/", None, "allow")


@pytest.mark.parametrize("name", ["op4_mixing", "op6_url_filter", "op8_warc_zip"])
def test_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE[name])


PAGES = "page_id long, url string, html string, payload_digest string, kind string"


def pages():
    big, huge = "<p>é</p>" * 20, "x" * 3_000_000
    return [(5, "http://a/\r\nb%", big), (3, None, big), (9, "http://c", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", huge), (8, "v", huge), (3, "w", big), (None, "only" * 50, "q" * 200)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*r, "a", "b") for r in pages()], PAGES).repartition(3)
    manifest = warc_zip.write(df)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages())
    got = warc_zip.read(manifest).collect()
    first = {}
    for i, _, html in pages():
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = collections.Counter()
    for i, url, html in pages():
        raw = (html or "").encode()
        again = raw in first and i != first[raw]
        want[(i, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None, None if again else raw)] += 1
    assert collections.Counter((r[0], r[1], r[2], r[3], r[4], r[5], None if r[6] is None else bytes(r[6])) for r in got) == want


def test_empty_pages(spark):
    assert warc_zip.read(warc_zip.write(spark.createDataFrame([], PAGES))).count() == 0


def _package(path, zip64, index=True, deflated=False):
    raw = [warc_zip.record(i, f"u{i}", b"p%d" % i * 60, hashlib.sha256(b"p%d" % i * 60).hexdigest(), "response", None) for i in range(9)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo(warc_zip.DATA), "w", force_zip64=zip64) as m:
            m.write(b"".join(raw))
        if index:
            at, lines = 0, []
            for i, r in enumerate(raw):
                lines.append(f"<urn:x-page:{i}> {at} {len(r)} response\n")
                at += len(r)
            z.writestr(warc_zip.INDEX, "".join(lines))
    return sum(map(len, raw))


@pytest.mark.parametrize("zip64, index", [(True, True), (False, True), (True, False), (False, False)])
def test_reader_of_foreign_packages(tmp_path, zip64, index):
    path = str(tmp_path / "x.zip")
    size = _package(path, zip64, index)
    found = list(warc_zip.ranges(path, most=400))
    assert sum(n for _, n in found) == size and (len(found) > 1) == index
    assert [r[0] for o, n in found for r in warc_zip.read_range(path, o, n)] == list(range(9))


def test_zip64_end_record(tmp_path, monkeypatch):
    path = str(tmp_path / "x.zip")
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # so that zipfile writes a ZIP64 end of central directory
    size = _package(path, True)
    assert b"PK\x06\x06" in open(path, "rb").read()
    with warc_zip._open(path, "r") as f:
        assert warc_zip.members(f)[warc_zip.DATA][1] == size
    assert [r[0] for o, n in warc_zip.ranges(path) for r in warc_zip.read_range(path, o, n)] == list(range(9))


def test_damage_is_noticed(tmp_path):
    bad = warc_zip.record(1, "u", b"payload" * 30, "0" * 64, "response", None)
    (tmp_path / "r").write_bytes(bad)
    with pytest.raises(ValueError):
        list(warc_zip.read_range(str(tmp_path / "r"), 0, len(bad)))
    with pytest.raises(ValueError):
        list(warc_zip.records([bad[:-9]]))
    with pytest.raises(ValueError):
        list(warc_zip.ranges(str(tmp_path / "r")))


DELTA = "source string, lang string, tokenizer string, sign int, n_tokens long"


def test_rollups_are_sums_and_batches_idempotent(spark):
    rng = random.Random(1)
    store, want = token_rollup.Rollup(spark, new_path(spark, "t")), collections.Counter()
    for b in range(4):
        rows = [(rng.choice(["a", None]), rng.choice(["en", None]), "v", rng.choice([1, 1, -1]), rng.randint(0, 9)) for _ in range(50)]
        df = spark.createDataFrame(rows, DELTA)
        assert store.commit(f"b{b}", df) and not store.commit(f"b{b}", df)
        for s, lang, t, sign, n in rows:
            want[s, lang, t, "d"] += sign
            want[s, lang, t, "n"] += sign * n
        if b == 2:
            store.compact("c1")
            assert not store.commit("b1", df)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}
    assert got == {k[:3]: (v, want[(*k[:3], "n")]) for k, v in want.items() if k[3] == "d" and (v or want[(*k[:3], "n")])}
    assert store.commit("empty", spark.createDataFrame([], DELTA)) and not store.commit("empty", spark.createDataFrame([], DELTA))


def test_compaction_that_broke_off_counts_once(spark, monkeypatch):
    store = token_rollup.Rollup(spark, new_path(spark, "t"))
    store.commit("a", spark.createDataFrame([("s", "en", "v", 1, 5)], DELTA))
    real = store._fs
    monkeypatch.setattr(store, "_publish", lambda *given, f=store._publish: (f(*given), (_ for _ in ()).throw(RuntimeError()))[0])
    with pytest.raises(RuntimeError):
        store.compact("c")
    assert store._fs == real and [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 5)]


def test_commits_during_a_compaction_are_not_lost(spark, monkeypatch):
    store = token_rollup.Rollup(spark, new_path(spark, "t"))
    one = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], DELTA)
    store.commit("a", one(10))
    real = token_rollup.Rollup._sums
    for at, name in enumerate(["b", "c", "d"]):
        monkeypatch.setattr(store, "_sums", lambda names, name=name: (store.commit(name, one(7)), real(store, names))[1])
        store.compact(f"k{at}")
        monkeypatch.setattr(store, "_sums", lambda names: real(store, names))
        assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", at + 2, 10 + 7 * (at + 1))]
        assert store.committed("a") and store.committed(name) and not store.commit(name, one(7))


def test_two_writers_of_one_batch_count_once(spark, monkeypatch):
    path = new_path(spark, "t")
    first, second = token_rollup.Rollup(spark, path), token_rollup.Rollup(spark, path)
    batch = spark.createDataFrame([("s", "en", "v", 1, 5)], DELTA)
    monkeypatch.setattr(second, "committed", lambda b: False)  # as if both had looked before either published
    assert first.commit("x/y", batch) and second.commit("x/y", batch) and len(first.batches()) == 2
    assert [tuple(r) for r in first.totals().collect()] == [("s", "en", "v", 1, 5)]
    first.compact("c")
    assert second.commit("x/y", batch) and [tuple(r) for r in first.totals().collect()] == [("s", "en", "v", 1, 5)]


def test_maintained_totals_equal_a_loop(spark):
    texts = ["hello world", "hello world", None, "", "ein anderer Text", "ein anderer Text", "x" * 5000, None]
    rows = [(i, t, ["s", None][i % 2], "en" if i < 3 else "de" if i < 7 else None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, docs int")
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    got = {tuple(r) for r in token_rollup.maintain(df, token_rollup.Rollup(spark, new_path(spark, "t")), old, new, queries.VOCABULARIES).collect()}
    count = {v: token_rollup.counter(token_rollup.vocabulary(f"{queries.VOCABULARIES}/{v}.tiktoken")) for v in (old, new)}
    docs, tokens, seen = collections.Counter(), collections.Counter(), set()
    for _, t, s, lang, _ in rows:
        if t not in seen:
            seen.add(t)
            v = old if lang == "en" else new
            docs[s, lang, v] += 1
            tokens[s, lang, v] += count[v](t)
    assert got == {(*k, n, tokens[k]) for k, n in docs.items()}
    assert token_rollup.maintain(df.where("doc_id < 0"), token_rollup.Rollup(spark, new_path(spark, "t")), old, new, queries.VOCABULARIES).count() == 0


def test_licenses_and_spans(spark):
    t = licenses.TEMPLATES
    mit, apache = t["MIT-text"], t["Apache-2.0-header"]
    worn = " ".join(w for i, w in enumerate(mit.split()) if i % 12 != 5).upper()
    rows = [(1, f"é intro\n{mit}\nend"), (2, f"x {worn} y"), (3, "Released under the MIT License."), (4, "nothing of the kind here at all"), (5, None), (6, ""), (7, " ".join(mit.split()[:15])), (8, f"{t['GPL-3.0']}. {'word ' * 50} {apache}"), (9, f"{t['CC-BY-NC-4.0']}\n{t['CC-BY-NC-4.0']}"), (None, t["ISC"]), (10, "w " * 200_000 + t["MIT"])]
    df = spark.createDataFrame([(i, x, "MIT", 0.0) for i, x in rows], "doc_id long, text string, license string, coverage double")
    got = licenses.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "ISC"), (1, "MIT-text"), (2, "MIT-text"), (3, "MIT"), (8, "Apache-2.0-header"), (8, "GPL-3.0"), (9, "CC-BY-NC-4.0"), (9, "CC-BY-NC-4.0"), (10, "MIT")]
    by = {(r["doc_id"], r["license"]): r for r in got}
    text = dict(rows)
    r = by[1, "MIT-text"]
    assert text[1][r["start"] : r["end"]] == mit[:-1] and r["coverage"] == 1
    assert 0.85 < by[2, "MIT-text"]["coverage"] < 1
    assert text[10][by[10, "MIT"]["start"] :] == t["MIT"]
    assert licenses.scan(df.where("doc_id < 0")).count() == 0


def test_parts_insertions_and_kin(spark):
    t = licenses.TEMPLATES
    mit = t["MIT-text"].split()
    half, torn = " ".join(mit[:70]), " ".join(mit[:60] + [f"added{i}" for i in range(10)] + mit[60:])
    rows = [(1, half), (2, torn), (3, t["BSD-2-Clause"]), (4, t["BSD-3-Clause"]), (5, "so " * 40 + torn + " so" * 40)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r["license"], r["complete"]) for i, r in got.items()} == {1: ("MIT-text", False), 2: ("MIT-text", True), 3: ("BSD-2-Clause", True), 4: ("BSD-3-Clause", True), 5: ("MIT-text", True)}
    assert [got[i]["coverage"] for i in (2, 3, 4, 5)] == [1] * 4 and got[1]["matched_words"] >= 70 and got[5]["start"] == 120


def test_texts_without_any_hit(spark):
    df = spark.createDataFrame([(1, "plain words only and more of them"), (2, None), (3, "")], "doc_id long, text string")
    assert licenses.scan(df).count() == 0


def every_alignment(template, text, gap=licenses.GAP):
    """Best local alignment by the whole table: score."""
    h = [[0.0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            h[i][j] = max(0, h[i - 1][j] - gap, h[i][j - 1] - gap, h[i - 1][j - 1] + 1 if template[i - 1] == text[j - 1] else 0)
    return max(map(max, h))


def test_alignment_equals_the_whole_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 30))
        assert licenses._local(a, b, -len(a), len(b))[2] == pytest.approx(every_alignment(a, b))
        matched, s, e = licenses.align(a, b, -len(a), len(b))
        assert every_alignment(a, b[s:e]) == pytest.approx(every_alignment(a, b)) and matched <= e - s


def test_scan_equals_every_template_at_every_place():
    """Documents with a worn notice of some template: the region found covers what the whole table finds."""
    rng = random.Random(4)
    small = {k: licenses.TEMPLATES[k] for k in ("MPL-2.0", "GPL-3.0", "Apache-2.0", "CC-BY-4.0")}
    index = licenses.Index(small)
    for k in range(60):
        name = rng.choice(list(small))
        w = small[name].split()
        for _ in range(rng.randint(0, len(w) // 8)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [f"new{i}" for i in range(rng.randint(0, 4))]
        text = [f"before{i}" for i in range(rng.randint(0, 30))] + w + [f"after{i}" for i in range(rng.randint(0, 30))]
        piece = next(licenses.pieces([" ".join(text)], licenses.NOT_ALNUM))
        found = {n: (c, m) for _, n, c, m, *_ in licenses._scan(piece, index, licenses.MIN_COVERAGE)}
        words = index.words[index.names.index(name)]
        share = lcs_bits(words.tolist(), piece.hash.tolist()) / len(words)
        if share >= 0.9:
            assert name in found and found[name][0] >= licenses.MIN_COVERAGE, (text, found)
        if name in found:
            assert found[name][0] <= share + 1e-9


def mixed(rows, entropy, most, seed=mixing.SEED, block=mixing.BLOCK_TOKENS):
    """The mixture by loops; rows: (doc_id, source, tokens)."""
    rows = [r for r in rows if r[2]]
    n = collections.Counter()
    for _, s, t in rows:
        n[s] += t
    whole, top = sum(n.values()), max(n.values())
    share = lambda a: {s: (x / top) ** a for s, x in n.items()}
    ent = lambda a: -sum(p / sum(share(a).values()) * math.log(p / sum(share(a).values())) for p in share(a).values())
    rep = lambda a: max(p / sum(share(a).values()) * whole / n[s] for s, p in share(a).items())
    grid = [i / 20000 for i in range(20001)]
    alpha = max((a for a in grid if ent(a) >= entropy * math.log(len(n)) - 1e-12), default=0) if len(n) > 1 else 1
    alpha = min((a for a in grid if a >= alpha and rep(a) <= most), default=1)
    return n, alpha, whole


def test_mixture_meets_targets_and_budgets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 30 + ["mid"] * 6 + ["small", None]), rng.randint(0, 40)) for i in range(1500)]
    df = spark.createDataFrame([(i, s, "w " * t if t else None, 5, 0) for i, s, t in rows], "doc_id long, source string, text string, tokens int, epoch int")
    for entropy, most in ((0.9, 4.0), (0.99, 100.0), (0.99, 2.0)):
        n, alpha, whole = mixed(rows, entropy, most)
        got = mixing.mix(df, entropy, most, block_tokens=300).collect()
        w = {s: (x / max(n.values())) ** alpha for s, x in n.items()}
        for s in n:
            took = sum(r["tokens"] for r in got if r["source"] == s)
            assert abs(took - w[s] / sum(w.values()) * whole) <= 45 + 0.002 * whole
            mine = collections.Counter(r["epoch"] for r in got if r["source"] == s)
            docs = sum(1 for r in rows if r[1] == s and r[2])
            assert all(mine[e] == docs for e in range(max(mine)))
        assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
        # the partial pass is a prefix of its permutation
        for s in n:
            last = max(r["epoch"] for r in got if r["source"] == s)
            order = sorted(got, key=lambda r: r["order_key"])
            inside = [r["doc_id"] for r in order if r["source"] == s and r["epoch"] == last]
            blocks = [r["block"] for r in order if r["source"] == s and r["epoch"] == last]
            assert blocks == sorted(blocks) and inside


def test_mixture_edges(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "a", ""), (3, None, None), (None, "b", "z")], "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert {r["doc_id"] for r in got} <= {1, None} and mixing.mix(df.where("doc_id > 9")).count() == 0
    want = sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    monkeypatch.setattr(mixing, "LOCAL_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(df).collect())) == want
