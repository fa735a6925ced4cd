"""MinHash near duplicates, embeddings and line dedup against plain computations."""

import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import embedding_dedup as E
from lattica.llm import line_dedup as L
from lattica.llm import minhash_dedup as M
from lattica.llm.shared import connected_components, shingles_of, text_chunks, words_of, written


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))] for _ in range(12)]
    rows = [(i, noisy(rng, base[i % 12], rng.choice([0, 0, 1, 2, 3, 6]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE "), (205, "É"), (206, "é"), (207, "a\x0bb\u00a0c"), (208, "A b\u00a0c"), (None, "one"), (209, "z " * 50_000), (210, "z")]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in rows], "doc_id long, text string, fp string, root long").repartition(5)
    got = {r.doc_id: r for r in M.near_duplicates(df, k).collect()}
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert len(links) > 100
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i), i
    assert got[None].component_id is None and not got[None].kept


def test_near_duplicates_of_nothing(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (3, "q r s t u v")], "doc_id long, text string")
    assert sorted(tuple(r) for r in M.near_duplicates(df).collect()) == [(1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (3, 2, 3, True)]


def test_one_id_for_several_texts(spark):
    a, b, z = ("a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12", "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11 b12", " z")
    rows = [(1, a), (1, b), (2, a + z), (3, b + z), (4, "q r s"), (4, "t u v"), (5, "t u v")]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = sorted(tuple(r) for r in M.near_duplicates(df, 2).select("doc_id", "component_id", "kept").collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False)]
    kept = M.without_near_duplicates(df.withColumns({c: F.lit(1) for c in ("_gone_id", "_gone_th", "row", "th")}), 2)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(r for r in rows if r[0] in (1, 4)) and kept.columns == ["doc_id", "text", "_gone_id", "_gone_th", "row", "th"]


def test_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, noisy(rng, base, rng.randrange(2, 8))) for i in range(120)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    sets = {i: shingle_set(t, 2) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert got == want and len(set(want.values())) > 1


def test_bayes_bounds():
    bounds = M.least_matches(80, 1e-6)
    assert [n for n, _ in bounds] == [42, 84, 126, 168, 210, 252] and all(0 < m < 0.8 * n for n, m in bounds)
    sig = np.arange(252, dtype=np.uint32)[None]
    half = sig.copy()
    half[:, ::2] += 1000
    assert M.plausible(sig, sig, 80, 1e-6).all() and not M.plausible(sig, half, 80, 1e-6).any()


def test_word_hashes():
    import pyarrow as pa

    texts = ["Ab  c", None, "", "aB", "c\x1cd", "x" * 300]
    for at, to, data, offsets in text_chunks(pa.array(texts), 8):
        words, first = words_of(data, offsets)
        for i in range(at, to):
            assert first[i - at + 1] - first[i - at] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or ""))
    chunk = next(text_chunks(pa.array(["Ab", "aB", "ab"])))
    words, _ = words_of(*chunk[2:])
    assert len(set(words.tolist())) == 1 and len(words) == 3 and len(shingles_of(words, 2)) == 1


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 450)] + [(500, 500 + i) for i in range(1, 60)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs + [(None, 4), (9999, 9999)], "a long, b long")).collect()}
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    # a path in a bad order, many rounds long, and ids of another type
    order = list(range(200))
    rng.shuffle(order)
    path = connected_components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a int, b int"))
    assert dict(path.dtypes) == {"node": "int", "root": "int"} and {(r.node, r.root) for r in path.collect()} == {(i, 0) for i in range(200)}


def brute_vectors(rows, least):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    links = {i: 0 for i, *_ in rows}
    pairs = []
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    pairs.append((a, b))
                    links[a] += 1
                    links[b] += 1
    return links, roots(links, pairs)


def test_dense_embeddings(spark, monkeypatch):
    # one group around one centre, in which cuts part many linked pairs, and spread vectors with near copies
    monkeypatch.setattr(E, "LEAF", 64)
    monkeypatch.setattr(E, "BLOCK", 256)
    rng = np.random.default_rng(4)
    dense = rng.standard_normal(32) / 32**0.5 * 0.93**0.5 + rng.standard_normal((1500, 32)) * (0.07 / 32) ** 0.5
    wide = rng.standard_normal((500, 32))
    x = np.concatenate([dense, wide, wide + rng.standard_normal((500, 32)) * 0.37])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in E.near_vectors(df).collect()}
    assert got == dict(enumerate((near.sum(1) - 1).tolist())) and near[:1500].sum() > 500_000


def planted(rng, n, dim, pairs):
    """n spread vectors with pairs of them that are just linked."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        side = rng.standard_normal(dim)
        side -= side @ x[2 * k] * x[2 * k]
        x[2 * k + 1] = 0.9305 * x[2 * k] + (1 - 0.9305**2) ** 0.5 * side / np.linalg.norm(side)
    return x


def test_recall_at_the_leaf_size_of_production(spark):
    rng = np.random.default_rng(7)
    x = planted(rng, 5000, 64, 400)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    near = x @ x.T >= 0.93
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df).collect()}
    want = roots(range(len(x)), np.argwhere(np.triu(near, 1)).tolist())
    assert got == {i: (int(near[i].sum()) - 1, want[i]) for i in range(len(x))} and near.sum() >= 5800
    # the forest has to compare far fewer than all pairs
    classes = written(df.withColumn("node", F.col("vec_id")), "classes")
    n = [r["count"] for r in E.forest(classes, 0.93).groupBy("leaf").count().collect()]
    assert sum(k * k for k in n) < 0.6 * len(x) ** 2


def test_one_vec_id_for_several_vectors(spark):
    rng = np.random.default_rng(1)
    u, v = rng.standard_normal((2, 16))
    rows = [(1, u), (1, v), (2, u * 2 + 0.01), (3, v + 0.01), (4, v - 0.01)]
    df = spark.createDataFrame([(i, x.tolist(), 5) for i, x in rows], "vec_id long, embedding array<double>, label int")
    for n in (1, 4):
        got = sorted(tuple(r) for r in E.near_vectors(df.repartition(n)).collect())
        assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


@pytest.mark.parametrize("leaf", [16, 512])
def test_embeddings(spark, monkeypatch, leaf):
    monkeypatch.setattr(E, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    centres = rng.standard_normal((40, 24))
    rows = []
    for i in range(400):
        v = centres[i % 40] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.25, 0.4, 3])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] * 24, 1), (1004, [None] * 24, 1), (1005, rows[0][1], None), (1006, rows[0][1], 0), (1007, rows[0][1][:8], 0), (1008, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("leaf", F.lit(1)).repartition(4)
    links, want = brute_vectors(rows, 0.93)
    got = {r.vec_id: r for r in E.near_vectors(df).collect()}
    assert sum(links.values()) > 300
    for i in links:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], want[i], want[i] == i), i
    assert E.near_vectors(df.filter("false")).count() == 0


def edits(a, b):
    if a == b:
        return 0
    for x, y in ((a, b), (b, a)):
        if len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x))):
            return 1
    return 1 if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 else 2


def test_line_dedup(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 9, 10, 11, 25, 80]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        change = rng.choice(["", "", "swap", "cut", "add"])
        at = rng.randrange(len(w))
        if change == "swap":
            w[at] = rng.choice(vocabulary)
        elif change == "cut":
            del w[at]
        elif change == "add":
            w.insert(at, "new")
        return rng.choice([" ", "  ", "\t"]).join(w).upper() + rng.choice(["", " "])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(6)))) for i in range(60)] + [(100, None), (101, ""), (None, "\n".join(" ".join(b) for b in base)), (102, "a " * 30_000)]
    unspaced = ["字" * 40, "字" * 39, "字" * 60 + " 文", "x" * 37 + " y"]  # without four words they count from 40 characters on
    rows += [(110, "\n".join(unspaced)), (111, "\n".join([unspaced[0], *unspaced])), (112, "x" * 37 + "  y\n" + "x" * 38 + "\ty")]
    seen, want = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        keep, gone = [], 0
        for one in text.split("\n"):
            w = [x for x in re.split(r"[ \t\r\f\x0B]+", one.lower()) if x]
            counts = len(w) >= 4 or len(" ".join(w)) >= 40
            again = counts and any(w == s or (len(w) >= 10 and len(s) >= 10 and abs(len(w) - len(s)) < 2 and edits(w, s) <= 1) for s in seen)
            if counts:
                seen.append(w)
            gone += again
            if not again:
                keep.append(one)
        want[i] = ("\n".join(keep), len(text.split("\n")), gone)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, gone string, th int, n_lines int").withColumn("_row", F.lit(1))
    out = L.without_repeated_lines(df)
    assert {"gone", "th", "n_lines", "n_removed"} <= set(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert sum(w[2] for w in want.values()) > 40
    for i, w in want.items():
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == w, i
    assert got[100].text is None and got[None].n_removed == 0
    assert L.without_repeated_lines(df.filter("false")).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "one and the same line of many words that two documents have"
    df = spark.createDataFrame([(1, line), (2, f"own\n{line}"), (None, line), (3, None)], "doc_id long, text string")
    names = ["_doc_id", "_th", "_gone", "row", "first", "pos", "a.b"]
    out = L.without_repeated_lines(df.select("*", *[F.lit(c).alias(c) for c in names]))
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    got = {(r[0], r[1]): tuple(r)[2:] for r in out.collect()}
    assert got == {(1, line): (*names, 1, 0), (2, "own"): (*names, 2, 1), (None, line): (*names, 1, 0), (3, None): (*names, 0, 0)}


def test_line_dedup_of_very_long_lines(spark):
    """Keys of a line of 100,000 words: their time once grew with the square of the words, for which jobs are ended after a minute."""
    words = [f"w{i * i % 9973}" for i in range(100_000)]
    other = words[:70_000] + ["new"] + words[70_001:]
    less = words[:31_999] + words[32_000:]
    far = words[:50_000] + ["two", "more"] + words[50_002:]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, other, less, far))], "doc_id long, text string")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        assert {r.doc_id: r.n_removed for r in L.without_repeated_lines(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 0}
    finally:
        timer.cancel()


def test_line_dedup_hashes_of_prefixes(spark):
    n = 2 * L.BLOCK * L.BLOCK + L.BLOCK
    sizes = [*range(2 * L.BLOCK + 2), L.BLOCK * L.BLOCK - 1, L.BLOCK * L.BLOCK, L.BLOCK * L.BLOCK + 1, n]
    df = spark.createDataFrame([(k, [str(i % 7) for i in range(k)]) for k in sizes], "k int, w array<string>")
    found = {r.k: r.p for r in df.select("k", L._prefixes(F.col("w")).alias("p")).collect()}
    whole = found[n]
    assert len(set(whole)) == n + 1
    assert all(p == whole[: k + 1] for k, p in found.items())
