"""Interpolated Kneser-Ney character models of words: counted and discounted in Spark, applied vectorised.

Text is read as words, runs of letters in lower case, each between two boundary marks; an n-gram stands inside one word
with its marks. N-grams are 64-bit hashes in one sorted array an order; for each, one column a class of discounted
probabilities and backoff weights. A model is as large as the distinct n-grams inside words of the texts that it is
fitted on, however often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import MULTIPLIER, mixed, run_hashes, sized, written

CHARS = 500_000
#: Counts that a task holds before it gives them to the shuffle, and those that it takes in before it sums them up.
HELD, PENDING = 2_000_000, 500_000
#: The rest of a distribution below unigrams: so many characters are thought possible.
ALPHABET = 5_000
DISCOUNT = 0.75
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)
    return _LETTER


class Words:
    """The words of some texts: hashes of distinct ones, and for each text its tokens as their numbers."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        self._data = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low])
        edge = np.diff(np.concatenate(([False], _letters()[self._data], [False])).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.token, self.hash = pd.factorize(run_hashes(self._data, starts, stops))
        self.n = len(self.hash)
        #: The tokens of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(starts, np.concatenate(([0], ends)))
        at = np.zeros(self.n, np.int64)
        at[self.token[::-1]] = np.arange(len(self.token))[::-1]
        self._start, self.length = starts[at], (stops - starts)[at]

    def counts(self, rows: np.ndarray | None = None) -> np.ndarray:
        """How often each distinct word stands in the texts whose mask is set."""
        keep = slice(None) if rows is None else np.repeat(rows, np.diff(self.first))
        return np.bincount(self.token[keep], minlength=self.n)

    def spelled(self, which: np.ndarray | None = None) -> Spelled:
        """Characters of the distinct words, or of those chosen."""
        start, length = (self._start, self.length) if which is None else (self._start[which], self.length[which])
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return Spelled(self._data[np.repeat(start, length) + inner], length, inner)

    def per_text(self, values: np.ndarray, reduce: np.ufunc = np.add) -> np.ndarray:
        """values of distinct words, summed (or else reduced) over each text's tokens; 0 for a text without words."""
        n = np.diff(self.first)
        out = np.zeros((len(n), *values.shape[1:]))
        if n.any():
            full = n > 0
            out[full] = reduce.reduceat(values[self.token], self.first[:-1][full], axis=0)
        return out


class Spelled:
    """Words as characters, each word between two marks (0)."""

    def __init__(self, letters: np.ndarray, length: np.ndarray, inner: np.ndarray):
        self.size = length + 2
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.chars = np.zeros(self.at[-1], np.uint32)
        self.chars[np.repeat(self.at[:-1] + 1, length) + inner] = letters
        self.place = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.size)

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """For k = 1 to order the hash of the k characters that end at each place; 0 where the word begins later."""
        h = np.zeros(len(self.chars), np.uint64)
        c = self.chars.astype(np.uint64) + np.uint64(1)
        for k in range(1, order + 1):
            before = np.zeros_like(h)
            before[1:] = h[:-1]
            h = mixed(before * MULTIPLIER + c + np.uint64(k << 40))
            h[self.place < k - 1] = 0
            yield h

    def keyed(self, order: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of one order that do not end with the first mark: hash, context, suffix, summed weights of their words."""
        lower, h = np.zeros(len(self.chars), np.uint64), np.zeros(len(self.chars), np.uint64)
        for g in self.grams(order):
            lower, h = h, g
        ok = np.flatnonzero(self.place >= max(1, order - 1))
        before = np.zeros_like(h)
        before[1:] = lower[:-1]
        return summed(h[ok], before[ok], lower[ok], np.repeat(weights, self.size, axis=0)[ok])


def summed(h: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct h with the first of each column of rest and the sum of the last."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    last = rest[-1][order]
    return h[first], *(x[order[first]] for x in rest[:-1]), np.add.reduceat(last, first, axis=0) if len(h) else last


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first text, texts) of about CHARS characters, or of one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, texts[at:]


def sampled_share(known: DataFrame, by: list[str], most: Column) -> DataFrame:
    """Rows of known (doc_id and the columns of by) whose hash of doc_id is in a share that gives about `most` rows a group, and times, that share's inverse.

    A share, not a ranking: no group is sorted or gathered in one place however many rows it has. All rows of smaller groups stay.
    """
    sizes = known.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("times", F.greatest(F.col("_n") / most, F.lit(1.0)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return known.join(sized(written(sizes, "sizes")), by).filter(place * F.col("times") < 1).drop("_n")


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(k, h, ctx, low, class, n): how often each n-gram of up to order characters stands in the texts (text, class) of a class.

    h is the n-gram's hash, ctx that of all but its last character, low that of all but its first.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        held = pending = 0

        def merged() -> int:
            for key, parts in found.items():
                found[key] = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
            return sum(len(x[0][0]) for x in found.values())

        def given() -> Iterator[pa.RecordBatch]:
            for (k, c), ((h, ctx, low, n),) in found.items():
                fixed = [pa.array(np.full(len(h), x, np.int32)) for x in (k, c)]
                yield pa.RecordBatch.from_arrays([fixed[0], *(pa.array(x.view(np.int64)) for x in (h, ctx, low)), fixed[1], pa.array(n)], ["k", "h", "ctx", "low", "class", "n"])
            found.clear()

        for batch in batches:
            classes = batch.column("class").to_numpy()
            for at, part in chunks(batch.column("text").to_pylist()):
                w, own = Words(part), classes[at : at + len(part)]
                for c in np.unique(own):
                    counts = w.counts(own == c)
                    which = np.flatnonzero(counts)
                    s = w.spelled(which)
                    for k in range(1, order + 1):
                        new = s.keyed(k, counts[which])
                        found.setdefault((k, int(c)), []).append(new)
                        pending += len(new[0])
                if pending > max(held, PENDING):
                    held, pending = merged(), 0
                    if held > HELD:
                        yield from given()
                        held = 0
        merged()
        yield from given()

    rows = texts.select("text", F.col("class").cast("int").alias("class")).mapInArrow(gather, "k int, h long, ctx long, low long, class int, n long")
    return rows.groupBy("k", "h", "ctx", "low", "class").agg(F.sum("n").alias("n"))


def fitted(texts: DataFrame, classes: int, order: int, shared: DataFrame | None = None, shared_order: int = 0) -> Model:
    """The model of texts (text, class from 0); only its discounted tables come to the driver.

    shared (k, h, ctx, n), of the first shared_order orders, replaces the classes' own lower distributions by one that
    all of them back off to. Of it the model holds what the texts have n-grams or contexts of: an n-gram that no class
    has seen has the same shared part in all, so leaving out the rest changes no comparison.
    """
    counts = written(gram_counts(texts, order), "grams")
    # continuation: distinct characters before it; what begins with a mark keeps its own count
    before = counts.groupBy((F.col("k") - 1).alias("k"), F.col("low").alias("h"), "class").agg(F.count("*").alias("c"))
    own = counts.filter(F.col("k") > shared_order).join(before, ["k", "h", "class"], "left").select("k", "h", "ctx", "class", F.coalesce("c", "n").alias("n"))
    heads = own.groupBy("k", "ctx", "class").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    if shared is not None:
        seen = counts.filter(F.col("k") <= shared_order).select("k", "h").distinct()
        contexts = counts.filter(F.col("k") < shared_order).select((F.col("k") + 1).alias("k"), F.col("h").alias("ctx")).distinct()
        contexts = contexts.unionAll(texts.sparkSession.createDataFrame([(1, 0)], "k int, ctx long"))
        own = own.unionByName(shared.join(seen, ["k", "h"], "left_semi").select("k", "h", "ctx", F.lit(-1).alias("class"), "n"))
        among = shared.join(contexts, ["k", "ctx"], "left_semi").groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        heads = heads.unionByName(among.select("k", "ctx", F.lit(-1).alias("class"), "total", "kinds"))
    heads = written(heads, "heads")
    p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).cast("float").alias("v")
    grams = own.join(heads, ["k", "ctx", "class"]).select("k", F.col("h").alias("h"), "class", p)
    backoff = heads.select("k", F.col("ctx").alias("h"), "class", (F.lit(DISCOUNT) * F.col("kinds") / F.col("total")).cast("float").alias("v"))
    return Model(grams.toArrow(), backoff.toArrow(), classes, order)


class Model:
    """log-probabilities of words under each class from tables (k, h, class, v): of n-grams with their discounted
    probabilities, and of contexts with their backoff weights. Class -1 stands for all classes."""

    def __init__(self, grams: pa.Table, backoff: pa.Table, classes: int, order: int):
        self.classes, self.order = classes, order
        made = [self._by_order(t, empty) for t, empty in ((grams, 0.0), (backoff, 1.0))]
        self.tables = [(*g, *b) for g, b in zip(*made, strict=True)]

    def _by_order(self, table: pa.Table, empty: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each order the sorted hashes and a column of values a class; what a class has not seen is empty."""
        k, h, c, v = (table.column(x).to_numpy() for x in ("k", "h", "class", "v"))
        out = []
        for i in range(1, self.order + 1):
            at = np.flatnonzero(k == i)
            keys, row = np.unique(h[at].view(np.uint64), return_inverse=True)
            values = np.full((len(keys), self.classes), empty, np.float32)
            own = c[at] >= 0
            values[row[own], c[at][own]] = v[at][own]
            values[row[~own]] = v[at][~own, None]
            out.append((keys, values))
        return out

    def scores(self, w: Spelled) -> np.ndarray:
        """log P of each word, marks included but for the first, one column a class."""
        p = np.full((len(w.chars), self.classes), 1 / ALPHABET)
        before = np.zeros(len(w.chars), np.uint64)
        for k, g in enumerate(w.grams(self.order), 1):
            h, prob, heads, backoff = self.tables[k - 1]
            ok = np.flatnonzero(w.place >= max(1, k - 1))
            ctx = np.zeros(len(w.chars), np.uint64)
            ctx[1:] = before[:-1]
            if len(heads) and len(h):
                i = np.minimum(np.searchsorted(heads, ctx[ok]), len(heads) - 1)
                seen = heads[i] == ctx[ok]
                rows, i = ok[seen], i[seen]
                q = p[rows] * backoff[i]
                j = np.minimum(np.searchsorted(h, g[rows]), len(h) - 1)
                hit = h[j] == g[rows]
                q[hit] += prob[j[hit]]
                p[rows] = q
            before = g
        logp = np.log(np.maximum(p, 1e-30))
        logp[w.place == 0] = 0
        return np.add.reduceat(logp, w.at[:-1], axis=0) if len(w.size) else np.zeros((0, self.classes))


class Scorer:
    """A model's scores of distinct words, remembered from one batch of texts to the next."""

    MOST = 1_000_000

    def __init__(self, model: Model):
        self.model, self.known, self.values = model, np.zeros(0, np.uint64), np.zeros((0, model.classes), np.float32)

    def __call__(self, w: Words) -> np.ndarray:
        out = np.zeros((w.n, self.model.classes), np.float32)
        new = np.ones(w.n, bool)
        if len(self.known) and w.n:
            i = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
            new = self.known[i] != w.hash
            out[~new] = self.values[i[~new]]
        which = np.flatnonzero(new)
        if len(which):
            out[which] = self.model.scores(w.spelled(which))
            if len(self.known) > self.MOST:
                self.known, self.values = self.known[:0], self.values[:0]
            which = which[np.argsort(w.hash[which])]
            at = np.searchsorted(self.known, w.hash[which])
            self.known, self.values = np.insert(self.known, at, w.hash[which]), np.insert(self.values, at, out[which], axis=0)
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3, steps: int = 50, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) of a logistic regression by Newton steps on standardised columns.

    Each row counts as often as times says, once where it is None.
    """
    times = np.ones(len(x)) if times is None else times
    mean = np.average(x, 0, times)
    scale = np.maximum(np.average((x - mean) ** 2, 0, times) ** 0.5, 1e-9)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    b = np.zeros(z.shape[1])
    ridge = weight * times.sum() * np.eye(len(b))
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (times * (p - y)) + ridge @ b
        d = np.linalg.solve((z * (times * (p * (1 - p) + 1e-9))[:, None]).T @ z + ridge, g)
        b -= d
        if np.abs(d).max() < 1e-8:
            break
    return mean, scale, b


def probability(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, b = fit
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ b[:-1] + b[-1], -30, 30)))
