"""Benchmark decontamination by a BM25 index of test items searched with block-max WAND.

Every passage of every text is a query. Impacts are divided by what an item's own words would score, so that one
threshold serves all items. A passage is skipped where the terms' highest impacts cannot reach it, then the blocks of
items whose highest impacts cannot; only in the blocks left are items scored, and those above the threshold are
verified by the overlap of question and answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import SMALL_BATCH, shingles_of, small_batches, text_chunks, words_of

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage retrieves it.
RETRIEVE = 0.5
#: Words of a shingle; overlap of the question that is enough, and that which is enough with the whole answer.
SHINGLE, OVERLAP, OVERLAP_WITH_ANSWER = 5, 0.8, 0.5
BLOCK = 16
#: Characters of items in one index; more items make further indexes, each of which is searched by all texts.
INDEX_CHARS = 20_000_000


class Index:
    """An inverted index of items (item_id, question, answer)."""

    def __init__(self, items: list[tuple]):
        items = sorted(items, key=lambda x: (len(x[1] or ""), x[0]))  # alike in length, so alike in impact
        self.ids = np.array([x[0] for x in items])
        words = [self._words(x[1]) for x in items]
        answers = [self._words(x[2]) for x in items]
        self.shingles = [shingles_of(w, SHINGLE) for w in words]
        self.size = [min(SHINGLE, len(w)) for w in words]
        self.answers = [shingles_of(w, len(w)) if len(w) else None for w in answers]
        self.answer_size = [len(w) for w in answers]
        longest = max(map(len, words), default=0)
        self.step = max(32, longest)
        self.width = 2 * self.step
        lengths = np.array([len(w) for w in words], float)
        doc = np.repeat(np.arange(len(words)), lengths.astype(int))
        self.terms, term = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(np.stack((term, doc)), axis=1, return_counts=True) if len(doc) else (np.zeros((2, 0), int), np.zeros(0))
        term, self.item = pair
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((len(words) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if len(lengths) else 1, 1))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[self.item])
        self.impact = impact / (RETRIEVE * np.bincount(self.item, impact, len(words)))[self.item]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # of each term and block of items the highest impact, and of each term
        block = self.item // BLOCK
        key = term * (len(words) // BLOCK + 1) + block
        first = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0))) if len(key) else np.zeros(0, int)
        self.block, self.block_most = block[first], np.maximum.reduceat(self.impact, first) if len(key) else self.impact
        self.block_at = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(key) else self.impact
        self.blocks = len(words) // BLOCK + 1

    @staticmethod
    def _words(text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return words_of(data, np.array([0, len(data)]), marks=True)[0]

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(words), -1)
        i = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[i] == words, i, -1)

    @staticmethod
    def _postings(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
        n = at[terms + 1] - at[terms]
        return np.repeat(at[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items (their places) that a query of these distinct terms scores at the threshold or more, and their scores over it."""
        if self.most[terms].sum() < 1:
            return np.zeros(0, int), np.zeros(0)
        p = self._postings(self.block_at, terms)
        open_ = np.bincount(self.block[p], self.block_most[p], self.blocks) >= 1
        if not open_.any():
            return np.zeros(0, int), np.zeros(0)
        p = self._postings(self.at, terms)
        p = p[open_[self.item[p] // BLOCK]]
        score = np.bincount(self.item[p], self.impact[p], len(self.ids))
        found = np.flatnonzero(score >= 1)
        return found, score[found]

    def search(self, words: np.ndarray, terms: np.ndarray) -> dict[int, tuple[float, float, float | None]]:
        """Of one text, for each item that a passage holds: score over the threshold, overlap of question and of answer."""
        out: dict[int, tuple[float, float, float | None]] = {}
        for s in range(0, max(1, len(words) - self.step), self.step):
            own = terms[s : s + self.width]
            own = own[own >= 0]
            if not len(own) or self.most[own].sum() < 1:  # repeated terms only raise the bound
                continue
            for i, score in zip(*self.retrieve(np.unique(own)), strict=True):
                passage = words[s : s + self.width]
                question = np.isin(self.shingles[i], shingles_of(passage, self.size[i])).mean() if len(passage) >= self.size[i] else 0.0
                n, answer = self.answer_size[i], None
                if n:  # an answer stands in the passage or just behind it
                    near = words[s : s + self.width + n + self.step]
                    answer = float(np.isin(self.answers[i], shingles_of(near, n)).mean()) if len(near) >= n else 0.0
                if question >= OVERLAP or (question >= OVERLAP_WITH_ANSWER and answer == 1.0):
                    new = (float(score), float(question), answer)
                    out[i] = max(out.get(i, new), new, key=lambda x: (x[1], x[0]))
        return out


def _indexes(items: DataFrame) -> list[Index]:
    """Indexes of bounded size over items (item_id, question, answer); items without an id or a word in their question match nothing."""
    small_batches(items.sparkSession, size=SMALL_BATCH)
    items = items.select("item_id", "question", "answer").filter("item_id is not null and question rlike '[^\\\\x00-\\\\x2f\\\\x3a-\\\\x40\\\\x5b-\\\\x60\\\\x7b-\\\\x7f]'")
    size = items.agg(F.sum(F.length("question") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    parts = size // INDEX_CHARS + 1
    return [Index([tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect()]) for i in range(parts)]


def _searched(batch: pa.RecordBatch, column: str, index: Index) -> Iterator[tuple[int, dict]]:
    for at, to, data, offsets in text_chunks(batch.column(column)):
        words, first = words_of(data, offsets, marks=True)
        terms = index.lookup(words)
        for i in range(to - at):
            yield at + i, index.search(words[first[i] : first[i + 1]], terms[first[i] : first[i + 1]])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the items (item_id, question, answer) found in docs (doc_id, text).

    Words are runs of letters and digits, A-Z lower-cased. An item is found where a passage holds 0.8 of its question's
    distinct 5-word shingles (or of its whole question if shorter), or half of them and its whole answer; score is the
    passage's BM25 score over the item's own, answer_overlap is null for items without an answer. Of several passages
    the one with the greatest overlap counts. Null and empty texts hold nothing. Rows that repeat or lack a doc_id each
    give their own rows, as do items that repeat an item_id. Other columns are ignored.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, hits in _searched(batch, "text", shared.value):
                    for k, (score, question, answer) in hits.items():
                        rows.append(i)
                        found.append((shared.value.ids[k].item(), score * RETRIEVE, question, answer))
                if rows:
                    cols = [batch.column("doc_id").take(pa.array(rows)), *(pa.array(c) for c in zip(*found, strict=True))]
                    cols[4] = cols[4].cast(pa.float64())
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (text and any other columns) in which no item is found.

    Every row is judged by its own whole text, repeated ones alike; null and empty texts hold no item and stay. Without
    items, or without rows, docs stay as they are.
    """
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hits for _, hits in _searched(batch, "text", shared.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of items, whose text is the question; it has no separate answers."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), benchmark_items(spark, sf_dir))
