"""Shards, phrases and the sources' divergence, against plain computations and against SQL."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lattica.llm import divergence as V
from lattica.llm import phrases as H
from lattica.llm import queries as Q
from lattica.llm import ranking as R
from lattica.llm import sharding as S
from lattica.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_phrases", "op13_divergence"])
def test_given_documents_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    if name == "op12_phrases":  # few phrases occur a hundred times among two hundred documents
        got = H.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=10).collect()
        sql = Q.SQL[name].replace("count(*) >= 100", "count(*) >= 10")
    else:
        got, sql = Q.QUERIES[name](spark, SF).collect(), Q.SQL[name]
    found = con.execute(sql)
    columns = sorted(d[0] for d in found.description)
    place = {d[0]: i for i, d in enumerate(found.description)}
    want = sorted(repr(tuple(x[place[c]] for c in columns)) for x in found.fetchall())
    assert sorted(got[0].asDict()) == columns and len(want) > 100
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == want


# Shards


def drawn(key, shard):
    at = 16 * (shard % 2)
    return (int(hashlib.md5(f"{shard // 2}/{key}".encode()).hexdigest()[at : at + 13], 16) + 0.5) / 16**13


def best(key, weights):
    return min((-math.log(drawn(key, i)) / w, i) for i, w in enumerate(weights) if w)[1]


def test_shards(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(400), rng.choice([None, "", "é" * 9, "x" * 70_000, "same"]), i) for i in range(900)] + [(7, "hot", -1)] * 500 + [(None, "no key", 0), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    weights = [1.0, 2.5, 0.0, 1.0, 0.5]
    out = S.sharded(docs, weights, 2.0, keep=["slot"])
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "grown_shard", "slot"]
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), zlib.crc32((t or "").encode()), "key", best("" if i is None else i, weights), best("" if i is None else i, [*weights, 2.0])) for i, t, _ in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r.grown_shard in (r.shard, 5) for r in got) and any(r.grown_shard == 5 for r in got) and not any(r.shard == 2 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    for own in by.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert S.sharded(docs, weights).filter("grown_shard is not null").count() == 0
    assert S.sharded(docs.filter("false"), weights).count() == 0
    with pytest.raises(ValueError, match="weights"):
        S.sharded(docs, [0.0])


def test_shares_follow_weights_and_texts_are_kept(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id as name", "cast(id as string) as text", "id as _0", "'x' as _row0")
    out = S.sharded(docs, [1.0, 2.0, 1.0], key="name", keep=["text", "_0", "_row0"])
    n = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert abs(n[1] - 10_000) < 400 and abs(n[0] - 5_000) < 300
    S.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.filter("text <> cast(name as string) or _0 <> name").count() == 0 and back.count() == 20_000


# Phrases


def plain_phrases(docs, least, longest, ranks):
    f, n = Counter(), Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        own = {w: a for (g, w), a in f.items() if g == lang and a >= least}
        held = {w[i:j] for w in own if len(w) > 1 for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and 100 * own[w] >= 100 * own[w[i:j]]}
        rows = []
        for w, a in own.items():
            if len(w) > 1 and w not in held:
                score, k = min((1000 * a * n[lang] // (own[w[:k]] * own[w[k:]]), k) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), own[w[:k]], own[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:ranks])]
    return out


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rng = random.Random(1)
    words = [*"abcdefg", "É", "É", "日本", "A", "B"]
    part = lambda: rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!\r\n", "\x0c", " ; "])
    docs = [("".join(rng.choice(words) + part() for _ in range(rng.randrange(60))), rng.choice(["x", "x", "y", None])) for _ in range(120)]
    docs += [(None, "x"), ("", "z"), (" ,. ", None)] + [("the very same phrase of words here", "x")] * 40 + [("q" * 3000 + " long", "y")] * 9 + [("one two " * 4000, "y")]
    df = spark.createDataFrame([(t, lang, 1) for t, lang in docs], "text string, lang string, blk int").repartition(3)
    got = H.collocations(df, least=6, ranks=25)
    assert [tuple(r) for r in got.sort("lang", "rank").collect()] == sorted(plain_phrases(docs, 6, 5, 25))
    assert H.collocations(df.filter("lang = 'z'"), least=1).count() == 0
    assert H.collocations(df.filter("false")).count() == 0


def test_scores_pass_64_bits(spark):
    """The product of three counts above 2**21 passes 64 bits."""
    df = spark.createDataFrame([("so it is " * 750_000, "x")] * 4, "text string, lang string")
    by = {r.phrase: r.score for r in H.collocations(df, longest=3).collect()}
    n = 9_000_000
    # every phrase of three words but the first one falls short of it by the four places where a text ends
    assert by["so it is"] == min(1000 * (n // 3) * n // (n // 3) ** 2, 1000 * (n // 3) * n // ((n // 3) * (n // 3)))
    assert set(by) == {"so it is", "it is so", "is so it"}


def test_phrases_of_many_groups(spark, monkeypatch):
    """Codes are dealt over more groups than there are buckets, most of them with few phrases or none that are frequent."""
    monkeypatch.setattr(H, "GROUP", 100)
    monkeypatch.setattr(H, "BLOCK", 2000)
    rng = random.Random(2)
    docs = [(" ".join(rng.choice("abcdefghijklmnop") for _ in range(150)), rng.choice("xy")) for _ in range(60)] + [("never twice", "z"), ("here is a phrase of six words", "x")] * 9
    got = H.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), least=8)
    assert [tuple(r) for r in got.sort("lang", "rank").collect()] == sorted(plain_phrases(docs, 8, 5, 2000))


def test_codes_and_packed_lists():
    rng = np.random.default_rng(0)
    for bits in (1, 2, 3, 12):
        every = np.arange(1 << bits)
        spread = H._spread(every, bits)
        assert sorted(spread.tolist()) == every.tolist() and H._spread(spread, bits, back=True).tolist() == every.tolist()
    codes = H.Codes(60_000, (10**9 * 60_000).bit_length(), 51)
    prefix, word = rng.integers(0, 10**9, 200_000), rng.integers(0, 60_000, 200_000)
    code = codes.of(prefix, word)
    assert [x.tolist() for x in codes.parts(code)] == [prefix.tolist(), word.tolist()]
    assert 3500 < min(n := np.bincount(codes.group(code), minlength=51)) and max(n) < 4400
    # one prefix with every word, and every prefix with one word, are dealt out as evenly
    for one in (codes.of(np.full(60_000, 7), np.arange(60_000)), codes.of(np.arange(60_000) * 1001, np.full(60_000, 3))):
        assert 900 < min(n := np.bincount(codes.group(one), minlength=51)) and max(n) < 1500
    length = rng.integers(1, 1 << 31, 999).astype(np.int32)
    gaps = rng.integers(0, 1 << 63, 999).astype(np.uint64)
    assert [x.tolist() for x in H._unpacked(H._packed(gaps, length), 999, np.uint64, np.int32)] == [gaps.tolist(), length.tolist()]


def test_rare_phrases_are_shuffled_packed(spark):
    """Of hundreds of thousands of pairs of frequent words few are frequent; the others cost a few bytes of shuffle each."""
    rng = random.Random(3)
    docs = [(" ".join(f"w{rng.randrange(1000)}" for _ in range(20_000)) + " so it goes" * 10, "x") for _ in range(20)]
    pairs = Counter(p for t, _ in docs for w in [t.split(" ")] for p in zip(w, w[1:]))
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    moved = lambda: sum(e.apply(i).totalShuffleWrite() for e in [executors()] for i in range(e.size()))
    before = moved()
    every, _ = H.frequent_phrases(spark.createDataFrame(docs, "text string, lang string").repartition(4), longest=2)
    text = sum(len(t) for t, _ in docs)
    got = {r.phrase: r.a for r in every.filter("size = 2").collect()}
    assert got == {" ".join(p): a for p, a in pairs.items() if a >= 100} and len(got) == 3
    # the texts themselves are dealt out once
    time.sleep(1)
    assert len(pairs) > 300_000 and moved() - before - text < 4 * len(pairs)


# Divergence


def plain_divergence(docs, least, ranks):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    c, df = Counter(), Counter()
    groups = sorted({(lang or "", source or "") for _, lang, source in docs})
    for text, lang, source in docs:
        found = term.findall((text or "").translate(lower))
        c.update((lang or "", source or "", t) for t in found)
        df.update((lang or "", t) for t in set(found))
    out = []
    for lang, source in groups:
        kept = [t for g, t in df if g == lang and df[g, t] >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(of, lang=lang, kept=kept):
            n = {t: sum(c[lang, s, t] for s in of) for t in kept}
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        n, p = shares([source])
        _, q = shares(sources)
        pairs = [(-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), s.encode()) for s in sources if s != source for r in [shares([s])[1]]]
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[t] and p[t] > q[t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(rows)]
    return out


@pytest.mark.parametrize("ranks", [3, 200])
def test_divergence(spark, ranks):
    rng = random.Random(2)
    words = ["a", "B", "b", "É", "é", "日本語", "don't", "x1y", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))]
    docs = [(" ".join(rng.choice(words[: rng.choice([5, 40, 98])]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "Z"])) for _ in range(200)]
    docs += [(None, "fr", "s1"), ("12 34", "fr", "s2"), ("", "en", "silent"), ("alone", "xx", "one"), ("rare " * 50, "en", "s1"), ("common " * 30_000, "en", "s2")] + [("twice over", "en", "s1")] * 4
    df = spark.createDataFrame([(t, lang, s, 1) for t, lang, s in docs], "text string, lang string, source string, term int").repartition(4)
    got = V.divergence(df, terms=ranks)
    assert sorted(map(tuple, got.collect())) == sorted(plain_divergence(docs, 3, ranks))
    assert V.divergence(df.filter("false")).count() == 0


def test_first_ranked(spark):
    rng = random.Random(3)
    rows = [("ties", 5, f"{i:05d}") for i in range(3000)] + [("wide", rng.randrange(1 << rng.randrange(1, 62)), f"é{i}") for i in range(2000)] + [("few", 1, "a"), ("few", 0, "b")]
    rows += [("most", 1 << 61, "x")] + [("most", 0, "same" * 10 + chr(200 + i // 26) * 3 + chr(97 + i % 26)) for i in range(600)]
    df = written(spark.createDataFrame(rows, "g string, value long, item string"), "ranked")
    for k in (1, 20):
        want = []
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))
            want += [(*r, i + 1) for i, r in enumerate(own[:k])]
        assert sorted(map(tuple, R.first_ranked(df, ["g"], k).collect())) == sorted(want)
    assert R.first_ranked(df.filter("false"), ["g"], 3).count() == 0
