"""Toxicity from class-conditional Kneser-Ney models.

Two character models of words, of toxic and of ordinary text, interpolate their counts down to one shared backoff
distribution whose counts come from all documents; an expression that neither class has seen enough of falls back to
it in both and so says nothing. A text's length-normalised log-likelihoods under the two are compared, over the whole
text and over its single words, and a logistic function fitted on texts that the models have not seen turns the
comparison into a probability. Where a label has more texts than are sampled of it, each stands for as many as it was
drawn from, so that the probability's prior is the labels' own at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.charlm import Scorer, Words, chunks, fitted, logistic, probability, sampled_share, summed
from lattica.llm.shared import SMALL_BATCH, sized, small_batches, written

ORDER, SHARED_ORDER = 6, 3
#: Of each label, about so many texts of at most so many characters are used at most for the models and for the
#: calibration: those whose hash of doc_id is in the share that gives so many.
SAMPLE, SAMPLE_CHARS = 3000, 30_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: log-likelihood ratio of a word that counts as a toxic expression.
STRONG = 5.0


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, calibration, times): about 4 * SAMPLE labelled texts at most, outside of the held-out fold.

    times is how many labelled texts of its kind and part a sampled one stands for: 1 below the cap. Of several texts of
    one doc_id the one with the least hash is used.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("f", fold()).filter(F.col("f") != HELD_OUT).select("doc_id", "toxic", (F.col("f") == CALIBRATION).alias("calibration"))
    texts = docs.filter((F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    there = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("th"))
    known = written(known.join(there, "doc_id"), "known")
    ids = sampled_share(known, ["toxic", "calibration"], F.lit(SAMPLE))
    rows = texts.withColumn("th", F.xxhash64("text")).join(sized(written(ids, "ids")), ["doc_id", "th"])
    return rows.dropDuplicates(["doc_id"]).drop("th")


def backoff_counts(docs: DataFrame, order: int = SHARED_ORDER) -> DataFrame:
    """(k, h, ctx, n): counts of all n-grams up to order in all texts; below the order, how many characters come before each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = [None] * order
        for batch in batches:
            for _, part in chunks(batch.column("text").to_pylist()):
                w = Words(part)
                s, c = w.spelled(), w.counts()
                for k in range(order):
                    new = s.keyed(k + 1, c)
                    found[k] = new if found[k] is None else summed(*map(np.concatenate, zip(found[k], new, strict=True)))
        for k, x in enumerate(found, 1):
            if x is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), k, np.int32)), *(pa.array(y.view(np.int64)) for y in x)], ["k", "h", "ctx", "low", "n"])

    rows = docs.select("text").mapInArrow(gather, "k int, h long, ctx long, low long, n long")
    rows = written(rows.groupBy("k", "h", "ctx", "low").agg(F.sum("n").alias("n")), "ngrams")
    before = rows.groupBy((F.col("k") - 1).alias("k"), F.col("low").alias("h")).agg(F.count("*").alias("c"))
    return written(rows.join(before, ["k", "h"], "left").select("k", "h", "ctx", F.coalesce("c", "n").alias("n")), "backoff")


def features(texts: list[str | None], scorer: Scorer) -> np.ndarray:
    """One row a text: the mean over its words of the log-likelihood ratio, the highest of one word by character and by
    word, the number and the share of words that are strongly toxic, and the number of words as a logarithm."""
    out = [np.zeros((0, 6))]
    for _, part in chunks(texts):
        w = Words(part)
        s = scorer(w)
        ratio = s[:, 1] - s[:, 0]
        n = np.diff(w.first)
        strong = w.per_text((ratio > STRONG).astype(float))
        least = np.maximum(n, 1)
        high = np.maximum(w.per_text(ratio / (w.length + 1), np.maximum), 0), np.maximum(w.per_text(ratio, np.maximum), 0)
        out.append(np.stack([w.per_text(ratio) / least, *high, np.log1p(strong), strong / least, np.log1p(n)], 1))
    return np.concatenate(out)


def _featured(rows: DataFrame, model: Broadcast) -> DataFrame:
    """(toxic, times, x): the features of each of rows (text, toxic, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            if len(batch):
                x = features(batch.column("text").to_pylist(), scorer)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("times"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "times", "x"])

    return rows.select("toxic", "times", "text").mapInArrow(run, "toxic int, times double, x array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by keep, held_out, score and predicted (1 where score >= 0.5) for every row of docs (doc_id, text).

    labels (doc_id, toxic) of the held-out fold are never read; toxic other than 0 and 1 and labels of no document are
    ignored, of two labels for one document the greater holds. Null and empty texts and texts without letters are
    scored as texts without words. Where a label has no text at all to learn from, every score is 0. Rows that repeat a
    doc_id each give a row; for a null one held_out is false. Other columns are ignored, also a kept one called as a result.
    """
    small_batches(docs.sparkSession, size=SMALL_BATCH)
    spark = docs.sparkSession
    rows = written(sampled(docs, labels), "sample")
    counts = {(r.toxic, r.calibration) for r in rows.select("toxic", "calibration").distinct().collect()}
    tables = None
    if {(0, False), (1, False)} <= counts:
        fit = rows.filter("not calibration")
        model = spark.sparkContext.broadcast(fitted(fit.select("text", F.col("toxic").alias("class")), 2, ORDER, backoff_counts(docs), SHARED_ORDER))
        # without calibration texts of both labels the models' own texts must do
        cal = rows.filter("calibration") if {(0, True), (1, True)} <= counts else fit
        # the order of the rows decides the last digits of the sums
        x = np.array(sorted((*r.x, r.toxic, r.times) for r in _featured(cal, model).collect()))
        tables = model, logistic(x[:, :-2], x[:, -2], 1e-4, times=x[:, -1])

    kept = ["doc_id", *(c for c in keep if c not in ("doc_id", "held_out", "score", "predicted"))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(tables[0].value) if tables else None
        for batch in batches:
            if len(batch):
                texts = batch.column(len(kept) + 1).to_pylist()
                p = probability(features(texts, scorer), tables[1]) if tables else np.zeros(len(batch))
                own = [batch.column(i) for i in range(len(kept) + 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "held_out", "score", "predicted"])

    table = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return table.mapInArrow(score, f"{schema}, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
