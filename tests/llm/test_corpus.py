"""Packing, decontamination and the pipeline's stages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate as D
from lattica.llm import packing as P
from lattica.llm.minhash_dedup import near_duplicates
from lattica.llm.shared import written


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_paths()[0])


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(0)
    texts = {i: " ".join(rng.choice(["alpha", "Bé", "x1", "<|endoftext|>", "日本語", "\n\n", "  "]) for _ in range(rng.randrange(0, 900))) for i in range(150)}
    texts |= {500: None, 501: "", 502: "word " * 9000}
    rows = [(i, t, 7) for i, t in texts.items()] + [(None, "none", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    out = P.pack_documents(df).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    by = {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.length, r.doc_tokens, r.ids_crc32) == (len(part), len(ids[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(by)) > 0.9
    assert P.pack_documents(df.filter("false")).count() == 0


def test_both_tokenizer_libraries_give_the_same_ids(tokenizer):
    rng, encode = random.Random(5), P._encoder(P.tokenizer_paths())
    ranges = [(32, 127), (9, 14), (0xA0, 0x250), (0x300, 0x600), (0x900, 0xE00), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xD7A0), (0x1F300, 0x1F700)]
    for _ in range(3000):
        own = rng.sample(ranges, 2)
        text = "".join(chr(rng.randrange(*rng.choice(own))) for _ in range(rng.randrange(40)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_long_runs_of_one_class(spark, tokenizer):
    runs = [" " * 2_000_000, "\n" * 1_500_000, "a" * 1_000_000, " \t\n" * 400_000, "word " * 500 + "\r\n" * 800_000 + "end", "7" * 900_000]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(3)
    got = {}
    for r in P.pack_documents(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(runs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[i]) == [(k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]


def test_plan_uses_each_piece_once():
    rng = random.Random(1)
    for window, n in ((2048, 30_000), (64, 500), (2048, 3)):
        h = Counter(rng.randrange(1, window + 1) for _ in range(n))
        used, full = Counter(), 0
        plan = P.plan(dict(h), window)
        for pattern, repeats in plan:
            size = sum(k * m for k, m in pattern.items())
            assert size <= window and repeats > 0
            full += size * repeats
            for k, m in pattern.items():
                used[k] += m * repeats
        assert used == h
        if n > 100:
            assert full / (window * sum(r for _, r in plan)) > 0.98
    assert P.plan({}) == [] and P.plan({5: 7}, 5) == [({5: 1}, 7)]
    # a histogram a thousand times as high needs no longer plan
    assert len(P.plan({k: 1000 * v for k, v in h.items()})) <= 3 * 2048


def test_one_length_may_hold_all(spark, monkeypatch):
    df = written(spark.createDataFrame([(i, 0, 300, "c") for i in range(1000)], "doc_id long, start long, length long, own string"), "t")
    out = P.pack(df)
    assert out.columns == ["doc_id", "start", "length", "own", "sequence_id", "offset"]
    assert Counter(Counter(r.sequence_id for r in out.collect()).values()) == {6: 166, 4: 1}
    monkeypatch.setattr(P, "SALTS", 1)
    monkeypatch.setattr(P, "RANKED", 7)
    clash = written(df.selectExpr("doc_id", "start", "length", "own as salt", "1 as n", "'x' as row", "2 as base", "own as `a.b`", "5L as sequence_id", "0 as offset"), "t")
    out = P.pack(clash)
    assert out.columns == ["doc_id", "start", "length", "salt", "n", "row", "base", "a.b", "sequence_id", "offset"]
    rows = out.collect()
    assert {(r.doc_id, r.salt, r.n, r.row, r.base, r["a.b"]) for r in rows} == {(i, "c", 1, "x", 2, "c") for i in range(1000)}
    assert Counter(Counter(r.sequence_id for r in rows).values()) == {6: 166, 4: 1}
    with pytest.raises(ValueError, match="lengths"):
        P.pack(df.selectExpr("doc_id", "start", "0L as length"))


def make_items(rng, n):
    vocabulary = [f"t{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))), " ".join(rng.choice(vocabulary) for _ in range(3)) if i % 3 == 0 else None) for i in range(n)], vocabulary


def brute(doc, items):
    """Items whose question has 0.8 of its shingles in some passage of the text, by the passages' own definition."""
    index = D.Index(items)
    words = D.Index._words(doc)
    out = set()
    for s in range(0, max(1, len(words) - index.step), index.step):
        passage = words[s : s + index.width]
        for k in range(len(index.ids)):
            grams = D.shingles_of(passage, index.size[k]) if len(passage) >= index.size[k] else np.zeros(0, np.uint64)
            q = np.isin(index.shingles[k], grams).mean()
            n = index.answer_size[k]
            near = words[s : s + index.width + n + index.step]
            a = n and len(near) >= n and np.isin(index.answers[k], D.shingles_of(near, n)).all()
            if q >= D.OVERLAP or (q >= D.OVERLAP_WITH_ANSWER and a):
                out.add(int(index.ids[k]))
    return out


def test_matches_against_brute_force(spark):
    rng = random.Random(4)
    items, vocabulary = make_items(rng, 60)
    rows = []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        if i % 2:
            _, q, a = rng.choice(items)
            q = q.split()
            if i % 4 == 1 and len(q) > 30:
                q[rng.randrange(len(q))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = q + (a.split() if a else [])
        rows.append((i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    extra = [(500, None), (501, ""), (None, items[5][1]), (502, (items[7][1] + " ") * 500)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows + extra], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([*items, (None, "t1 t2 t3", None), (998, None, "x"), (999, " !", None)], "item_id long, question string, answer string")
    out = D.matches(df, table).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.item_id)
    found = 0
    for i, t in rows + extra:
        want = brute(t or "", items)
        found += len(want)
        assert got.get(i, set()) == want, i
    assert found > 40
    left = {r.doc_id for r in D.without_leaks(df, table).collect()}
    assert left == {i for i, t in rows + extra if not brute(t or "", items)}
    assert D.matches(df, table.filter("false")).count() == 0 and D.matches(df.filter("false"), table).count() == 0
    assert D.without_leaks(df, table.filter("false")).count() == df.count()


def test_wand_misses_nothing():
    rng = random.Random(6)
    items, vocabulary = make_items(rng, 100)
    index = D.Index(items)
    full = np.zeros((len(index.terms), len(index.ids)))
    for t in range(len(index.terms)):
        for p in range(index.at[t], index.at[t + 1]):
            full[t, index.item[p]] += index.impact[p]
    for _ in range(200):
        query = np.unique(rng.sample(range(len(index.terms)), rng.randrange(1, 120)))
        score = full[query].sum(0)
        found, got = index.retrieve(query)
        assert set(found) == set(np.flatnonzero(score >= 1 - 1e-12)) and np.allclose(got, score[found])


def test_several_indexes_find_the_same(spark, monkeypatch):
    items, _ = make_items(random.Random(8), 30)
    df = spark.createDataFrame([(i, f"t1 {q} t2") for i, q, _ in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    one = {(r.doc_id, r.item_id) for r in D.matches(df, table).collect()}
    monkeypatch.setattr(D, "INDEX_CHARS", 2000)
    assert {(i, i) for i, *_ in items} <= one == {(r.doc_id, r.item_id) for r in D.matches(df, table).collect()}


def test_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontaminate", "packing"]
    for name, stage in C.STAGES[:-1]:
        n = docs.count()
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        assert stage(spark, docs.filter("false"), sf).count() == 0
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any(q in t for _, q, _ in items for t in texts.values())
    out = C.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    near = near_duplicates(docs).collect()
    assert all(r.kept for r in near)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, long texts and clashing names go through all stages; clean rows stay."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    clean = "an ordinary report about the harvest of apples in the northern valleys during a mild autumn"
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, clean, "en", None, None), (1, clean, "en", None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a text without any number of its own", None, "s", 3)]
    rows += [(4, long, "en", "s", len(long)), (5, " " * 700_000, "en", "s", 700_000), (6, long + " more", "en", "s", 1), (6, "another text under the same number", "en", "s", 1)]
    names = ["_gone", "_th", "_doc_id", "_gone_id", "_row", "row", "score", "predicted", "n_removed"]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(1).alias(c) for c in names]), "odd")
    kept = None
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        kept = Counter((r.doc_id, (r.text or "")[:20]) for r in docs.collect())
        assert kept[None, "a text without any n"] == 1 and kept[2, ""] == 1 and kept[6, "another text under t"] == 1, name
        if name == "minhash_dedup":  # the later copy of the long text goes at one of the first stages
            assert sum(n for (i, t), n in kept.items() if t.startswith("word0")) == 1
    out = C.STAGES[-1][1](spark, docs, sf).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in out} == {i for i, _ in kept}
