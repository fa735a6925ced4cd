"""A corpus from documents to packed sequences: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.decontaminate import benchmark_items, without_leaks
from lattica.llm.line_dedup import without_repeated_lines
from lattica.llm.minhash_dedup import without_near_duplicates
from lattica.llm.packing import pack_documents
from lattica.llm.shared import written
from lattica.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by what the labels teach; labels are never looked up for a document judged.

    Null and empty texts are judged as texts without words; rows without or with a repeated doc_id are judged by their
    own text, equal ones alike. Without labels of both kinds all stay. Columns of any name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    return toxicity(rows, labels, keep=("_row",)).filter("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those of which nothing is left go. n_chars is the new length.

    Null and empty texts and rows without a doc_id stay as they are. Of equal lines the one with the least (doc_id, place)
    stays; equal rows of one doc_id keep the same lines. Columns of any name pass through.
    """
    rows = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    out = without_repeated_lines(rows).filter("n_removed = 0 or length(trim(text)) > 0")
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_row.n_chars")).cast("bigint")}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The least doc_id of a group stays. Texts without words and rows without a doc_id stay; rows of one doc_id stay or go
    by their own texts. Columns of any name pass through.
    """
    return without_near_duplicates(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none. Columns of any name pass through."""
    return without_leaks(docs, benchmark_items(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048; every row gives its own, a null or empty text the end mark alone."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack_sequences),
]

#: The first stage's models cannot be said in SQL; tests hold every stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
