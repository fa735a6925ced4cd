"""Language by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

The models are counted over all texts of known language outside of the held-out fold and of the calibration fold. The
language whose model gives a text the lowest cross-entropy a character is chosen. How sure that is, is a logistic
function of the distance to the second and of the length, fitted on all texts of the calibration fold, which the models
have not seen; texts below a wanted certainty can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.charlm import Scorer, Words, chunks, fitted
from lattica.llm.shared import small_batches, written

ORDER = 5
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
UNKNOWN = "und"
#: Sums over all texts are taken in units of 2**-36, so that they are the same in whatever order and parts they are added.
UNIT = 2.0**36
#: Ridge of the calibration a text, most Newton steps.
RIDGE, STEPS = 1e-4, 25


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def known(docs: DataFrame) -> DataFrame:
    """(text, lang, calibration) of all rows to learn from: those with text, lang and doc_id outside of the held-out fold."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    return rows.select("text", "lang", (fold() == CALIBRATION).alias("calibration"))


def entropies(texts: list[str | None], scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean log-probability of a character under each language, and the number of characters (0: no letters)."""
    out, sizes = [np.zeros((0, scorer.model.classes))], [np.zeros(0)]
    for _, part in chunks(texts):
        w = Words(part)
        n = w.per_text((w.length + 1).astype(float))
        out.append(w.per_text(scorer(w).astype(float)) / np.maximum(n, 1)[:, None])
        sizes.append(n)
    return np.concatenate(out), np.concatenate(sizes)


def margins(means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row a text: the distance from the best to the second language, a character and in all, and the length."""
    top = np.sort(means, 1)
    gap = top[:, -1] - top[:, -2] if means.shape[1] > 1 else np.ones(len(means))
    return np.stack([gap, np.log1p(gap * sizes), np.log1p(sizes)], 1)


def _judged(docs: DataFrame, model: Broadcast, learned: str) -> DataFrame:
    """(doc_id, held_out, best, x, right) of docs (doc_id, text, class): the likeliest class, the margins and, for rows
    where the condition `learned` holds, whether their own class is the likeliest. best is null for texts without letters."""
    names = ["doc_id", "held_out", "best", "x", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            if len(batch):
                means, sizes = entropies(batch.column("text").to_pylist(), scorer)
                best = means.argmax(1).astype(np.int32)
                own = batch.column("class").to_numpy(zero_copy_only=False)
                right = pa.array(best == own, mask=(own < 0) | (sizes == 0))
                x = pa.array(list(margins(means, sizes)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, mask=sizes == 0), x, right], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = F.when(F.expr(learned), F.col("class")).otherwise(F.lit(-1))
    table = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text", F.coalesce(own, F.lit(-1)).alias("class"))
    return table.mapInArrow(run, f"doc_id {kind}, held_out boolean, best int, x array<double>, right boolean")


def _sums(rows: DataFrame, terms) -> np.ndarray:
    """Sums over all of rows (x, right) of the columns that terms(x, right) gives, in whole units; a task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
                part = np.rint(terms(x, batch.column("right").to_numpy(zero_copy_only=False).astype(float)) * UNIT).astype(np.int64).sum(0)
                total = [int(p) + (total[i] if total else 0) for i, p in enumerate(part)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["t"])

    parts = [list(map(int, r.t)) for r in rows.select("x", "right").mapInArrow(run, "t array<string>").collect()]
    # one right and one wrong case are added, so that certainty never is complete
    more = np.rint(terms(np.array([[0.0, 0.0, 0.0], [1.0, 5.0, 5.0]]), np.array([0.0, 1.0])) * UNIT).astype(np.int64).tolist()
    return np.array([sum(c) / UNIT for c in zip(*parts, *more, strict=True)])


def calibrated(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) of a logistic regression of right on x over all rows (x, right).

    Newton steps whose sums Spark takes; the driver gets 14 numbers a task and step.
    """
    s = _sums(rows, lambda x, y: np.column_stack((np.ones(len(x)), x, x * x)))
    n, d = s[0], (len(s) - 1) // 2
    mean = s[1 : d + 1] / n
    scale = np.maximum(np.maximum(s[d + 1 :] / n - mean**2, 0) ** 0.5, 1e-9)
    ridge = RIDGE * n * np.eye(d + 1)
    ridge[-1, -1] = 1e-9
    upper = np.triu_indices(d + 1)
    b = np.zeros(d + 1)
    for _ in range(STEPS):

        def terms(x: np.ndarray, y: np.ndarray, b: np.ndarray = b) -> np.ndarray:
            z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            return np.column_stack((z * (p - y)[:, None], z[:, upper[0]] * z[:, upper[1]] * (p * (1 - p) + 1e-9)[:, None]))

        s = _sums(rows, terms)
        h = np.zeros((d + 1, d + 1))
        h[upper] = s[d + 1 :]
        step = np.linalg.solve(h + np.triu(h, 1).T + ridge, s[: d + 1] + ridge @ b)
        b = b - step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, b


def languages(docs: DataFrame, reject_below: float = 0.0) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang).

    lang_pred is a learned language, or und for texts that are null or without a letter and for those whose score is
    below reject_below; score is 0 where nothing could be predicted. lang is read only outside of the held-out fold and
    never at a prediction; null ones are not learned. All other rows are learned from, each as often as it is there,
    but for those without a doc_id, which are in no fold: for them held_out is false. Rows that repeat a doc_id each
    give a row. Without a language to learn everything is und. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = known(docs)
    parts = {(r.lang, r.calibration) for r in rows.select("lang", "calibration").distinct().collect()}
    # where one fold has nothing, the other serves for both
    fit = rows.filter("not calibration") if any(not c for _, c in parts) else rows
    names = sorted({x for x, c in parts if not c} or {x for x, _ in parts})
    if not names:
        none = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"))
        return none.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "class int, lang string"))
    model = spark.sparkContext.broadcast(fitted(fit.join(number, "lang").select("text", "class"), len(names), ORDER))
    both = {x for x, c in parts if c} & set(names) and any(not c for _, c in parts)
    own = f"pmod(crc32(cast(doc_id as string)), {FOLDS}) " + (f"= {CALIBRATION}" if both else f"!= {HELD_OUT}")
    judged = written(_judged(docs.select("doc_id", "text", "lang").join(number, "lang", "left"), model, own), "judged")
    mean, scale, b = calibrated(judged.filter("right is not null"))
    z = sum(((F.col("x")[i] - float(mean[i])) / float(scale[i]) * float(b[i]) for i in range(len(mean))), F.lit(float(b[-1])))
    score = F.when(F.col("best").isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).otherwise(F.lit(0.0))
    found = F.when(F.col("best").isNotNull() & (F.col("score") >= reject_below), F.array(*map(F.lit, names))[F.col("best")]).otherwise(F.lit(UNKNOWN))
    return judged.withColumn("score", score).select("doc_id", "held_out", found.alias("lang_pred"), "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
