"""Toxicity and language: held-out accuracy, what the models are never to read, and edge cases."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm.charlm import Model, Scorer, Words, fitted, logistic
from lattica.llm.langid import calibrated, languages
from lattica.llm.toxicity import backoff_counts, features, toxicity

SYLLABLES = {"aa": ["ka", "ro", "mi", "tes", "lun"], "bb": ["sch", "ein", "tze", "gra", "ub"], "cc": ["ção", "lhe", "nia", "oes", "qui"]}


def text(rng, lang, n, bad=0):
    w = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(bad):
        w.insert(rng.randrange(len(w)), rng.choice(["vile", "wretch", "scoundrel"]))
    return " ".join(w) + "."


def make(rng, n):
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        bad = rng.random() < 0.25
        rows.append((i, text(rng, lang, rng.randrange(5, 120), rng.randrange(1, 4) if bad else 0), lang))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = make(random.Random(0), 700)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    extra = [(900, None, None), (901, "", "aa"), (902, "123 !!", None), (None, "vile vile", None), (903, "ka " * 40_000, "aa")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    # the held-out fold's labels are turned around: they must not matter
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels] + [(5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    out = toxicity(df, turned, keep=("lang",)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(extra)
    truth = dict(labels)
    right = [got[i].predicted == truth[i] for i in held]
    assert np.mean(right) > 0.95 and {i for i in truth if got[i].held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0 and got[None].held_out is False
    assert got[0].lang == rows[0][2]


def test_toxicity_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a text", 7, 8, 9)], "doc_id long, text string, score int, _text int, other int")
    out = toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"), keep=("score", "_text", "other", "text"))
    assert out.columns == ["doc_id", "_text", "other", "text", "held_out", "score", "predicted"] and tuple(out.first())[:4] == (1, 8, 9, "a text") and out.first().score == 0


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(df, none).collect()} == {0.0}
    assert toxicity(df.filter("false"), none).count() == 0


def test_toxicity_prior_does_not_move_with_the_sample(spark, monkeypatch):
    # labels that texts say nothing of, one in ten toxic: the score is the prior, also where both labels are capped
    rng = random.Random(2)
    rows = [(i, text(rng, "aa", rng.randrange(5, 20)), int(rng.random() < 0.1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr("lattica.llm.toxicity.SAMPLE", 60)
    out = toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    assert abs(np.mean([r.score for r in out]) - 0.1) < 0.07 and np.mean([r.predicted for r in out]) < 0.1


def test_logistic_counts_rows_by_their_times():
    rng = np.random.default_rng(0)
    x, times = rng.standard_normal((40, 2)), rng.integers(1, 5, 40)
    y = (x[:, 0] + rng.standard_normal(40) > 0).astype(float)
    once, often = logistic(x, y, times=times.astype(float)), logistic(np.repeat(x, times, 0), np.repeat(y, times))
    assert all(np.allclose(a, b) for a, b in zip(once, often, strict=True))


def test_languages(spark):
    rows, _ = make(random.Random(1), 400)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    extra = [(900, None, "aa"), (901, "12 34", None), (902, "", "bb"), (None, "karo mi", "aa"), (903, "sch " * 50_000, None)]
    out = languages(spark.createDataFrame(wrong + extra, "doc_id long, text string, lang string")).collect()
    got = {r.doc_id: r for r in out}
    held = [i for i, *_ in rows if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert {r.lang_pred for r in out} <= {"aa", "bb", "cc", "und"}
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"] and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in out) and got[None].held_out is False
    sure = languages(spark.createDataFrame(wrong, "doc_id long, text string, lang string"), reject_below=1.1).collect()
    assert {r.lang_pred for r in sure} == {"und"}


def test_languages_learn_from_every_row(spark):
    # of 3,000 texts a language 60 have a word of their own, one stands in a text of 30,000 characters, one in a second row of a doc_id
    rng = random.Random(3)
    ids = [i for i in range(12_500) if zlib.crc32(str(i).encode()) % 4 < 2][:6000]
    rows = [(i, "ka ro mi tes lun", "ab"[k % 2]) for k, i in enumerate(ids)]
    own = ["".join(rng.choice("bcdfghjkqvwxyz") for _ in range(9)) for _ in range(60)]
    for j, word in enumerate(own):
        i, t, lang = rows[j * 99]
        rows[j * 99] = (i, f"{t} {word} {word}" + " ka" * (10_000 if j == 7 else 0), lang)
    rows[8 * 99] = (rows[0][0], *rows[8 * 99][1:])
    asked = [(100_000 + j, " ".join([word] * 20), None) for j, word in enumerate(own)]
    out = languages(spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")).filter("doc_id >= 100000").collect()
    assert {r.doc_id - 100_000: r.lang_pred for r in out} == {j: "ab"[j * 99 % 2] for j in range(60)}


def test_calibration_is_the_plain_logistic_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 3)) * [1, 5, 9]
    y = x[:, 0] * 4 + rng.standard_normal(500) > 1
    got = calibrated(spark.createDataFrame([(list(map(float, a)), bool(c)) for a, c in zip(x, y, strict=True)], "x array<double>, right boolean").repartition(5))
    want = logistic(np.concatenate((x, [[0, 0, 0], [1, 5, 5]])), np.append(y.astype(float), [0.0, 1.0]), 1e-4)
    assert all(np.allclose(a, c, atol=1e-6) for a, c in zip(got, want, strict=True))


def test_languages_without_any(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert languages(df).first().lang_pred == "und" and languages(df.filter("false")).count() == 0


def test_a_worker_needs_little_memory_for_many_texts():
    # a batch of 8 MB: what is held at once follows from a step's characters, not from the batch
    rng = random.Random(4)
    words = ["".join(rng.choice(SYLLABLES["aa"]) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=250)) for _ in range(4000)]
    model = Model(*[pa.table({"k": pa.array([], pa.int32()), "h": pa.array([], pa.int64()), "class": pa.array([], pa.int32()), "v": pa.array([], pa.float32())})] * 2, 2, 3)
    scorer = Scorer(model)
    tracemalloc.start()
    got = features(texts, scorer)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 8e6 and most < 60e6, most
    # words that were remembered from another step score the same
    assert np.array_equal(got[::500], features(texts[::500], Scorer(model)))


def test_probabilities_add_up(spark):
    m = fitted(spark.createDataFrame([("abab abc cab", 0), ("bca aab", 1)], "text string, class int"), 2, 3)
    w = Words(["a b c " + " ".join("abc"[i] + "abc"[j] for i in range(3) for j in range(3))])
    p = np.exp(m.scores(w.spelled()))
    assert (p > 0).all() and (p.sum(0) <= 1 + 1e-6).all()
    # what follows one context is a distribution over all characters of which these are some
    assert np.allclose(Scorer(m)(w), m.scores(w.spelled()), atol=1e-5)


def plain_model(words, order, discount=0.75, alphabet=5000):
    """Interpolated Kneser-Ney over words with marks, written as its definition."""
    grams = [{} for _ in range(order + 1)]
    for w in words:
        s = "^" + w + "^"
        for k in range(1, order + 1):
            for end in range(1, len(s)):
                if end - k + 1 >= 0:
                    g = (end - k + 1 == 0, s[end - k + 1 : end + 1])
                    grams[k][g] = grams[k].get(g, 0) + 1

    def count(k, g):
        if k == order or g[0]:
            return grams[k].get(g, 0)
        return sum(1 for u in grams[k + 1] if u[1][1:] == g[1] and not (g[0]))

    def prob(ctx, x):
        p = 1 / alphabet
        for k in range(1, order + 1):
            if k - 1 > len(ctx):
                break
            head = ctx[len(ctx) - k + 1 :]
            starts = len(head) == len(ctx) and k - 1 == len(ctx)
            own = {g: count(k, g) for g in grams[k] if g[1][:-1] == head and g[0] == (starts and k > 1)}
            total = sum(own.values())
            if total:
                kinds = sum(v > 0 for v in own.values())
                p = max(own.get((starts and k > 1, head + x), 0) - discount, 0) / total + discount * kinds / total * p
        return p

    return prob


def test_kneser_ney_against_its_definition(spark):
    words = ["abab", "abc", "cab", "bca", "aab", "abab"]
    m = fitted(spark.createDataFrame([(" ".join(words), 0)], "text string, class int"), 1, 3)
    prob = plain_model(words, 3)
    for w in ["ab", "abc", "cc", "bx"]:
        s = "^" + w + "^"
        want = sum(np.log(prob(s[:i], s[i])) for i in range(1, len(s)))
        assert m.scores(Words([w]).spelled())[0, 0] == pytest.approx(want, rel=1e-4), w


def shared_model(words, all_words, order, shared_order, discount=0.75, alphabet=5000):
    """As plain_model, but below shared_order with counts of all_words, that few characters before a mark apart."""
    marked = lambda ws: ["^" + w + "^" for w in ws]

    def table(ws, k, top):
        out, before = {}, {}
        for s in marked(ws):
            for end in range(max(1, k - 1), len(s)):
                g = (end - k + 1 == 0, s[end - k + 1 : end + 1])
                out[g] = out.get(g, 0) + 1
                if end - k >= 0:
                    before.setdefault(g, set()).add((end - k == 0, s[end - k]))
        return {g: n if k == top or g not in before else len(before[g]) for g, n in out.items()}

    tables = [table(all_words if k <= shared_order else words, k, shared_order if k <= shared_order else order) for k in range(1, order + 1)]

    def prob(ctx, x):
        p = 1 / alphabet
        for k in range(1, min(order, len(ctx) + 1) + 1):
            head, starts = ctx[len(ctx) - k + 1 :], k > 1 and k - 1 == len(ctx)
            own = {g: n for g, n in tables[k - 1].items() if g[1][:-1] == head and g[0] == starts}
            total = sum(own.values())
            if total:
                p = max(own.get((starts, head + x), 0) - discount, 0) / total + discount * len(own) / total * p
        return p

    return prob


def test_shared_backoff_against_its_definition(spark):
    # words drawn at random: of each class the models' own, of all the backoff; scores of words made of seen pieces
    rng = random.Random(8)
    make_words = lambda n: ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    own, rest = [make_words(15), make_words(15)], make_words(30)
    texts = spark.createDataFrame([(" ".join(own[0]), 0), (" ".join(own[1]), 1)], "text string, class int")
    everything = own[0] + own[1] + rest
    docs = spark.createDataFrame([(" ".join(own[0]),), (" ".join(own[1]),), (" ".join(rest),)], "text string").repartition(3)
    m = fitted(texts, 2, 4, backoff_counts(docs, 2), 2)
    probs = [shared_model(own[c], everything, 4, 2) for c in (0, 1)]
    for w in own[0] + own[1]:
        s = "^" + w + "^"
        got = m.scores(Words([w]).spelled())[0]
        for c in (0, 1):
            assert got[c] == pytest.approx(sum(np.log(probs[c](s[:i], s[i])) for i in range(1, len(s))), rel=1e-4), (w, c)


def test_repeated_ids_learn_the_same(spark):
    rows, labels = make(random.Random(6), 300)
    docs = spark.createDataFrame(rows + [(i, "karo " + t, x) for i, t, x in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    once, again = ({(r.doc_id, round(r.score, 9)) for r in toxicity(d, known).collect()} for d in (docs.repartition(7), docs.repartition(2, "text")))
    assert once == again
