"""Vocabularies: distinct strings of columns, categories and texts, numbered in the order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.sources.annotation import Annotation, SType
from lattica.sources.database import written
from lattica.sources.tables import RawDatabase

def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _part, the number of the range of the order that a row is in.

    It is written down, since ranges are found by sampling and would differ from one computation to the next.
    """
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with a dense number from 0 in the order of the columns, without one task that holds all rows.

    Each range of the order is numbered by itself and starts where the counts of those before it end.
    """
    parts = ranged(df, order)
    parts_n = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # one row a range
    return parts_n.join(F.broadcast(before), "_part").withColumn(name, F.col("_n") - 1 + F.col("_before")).drop("_part", "_n", "_before")


def column_texts(spark: SparkSession, annotation: Annotation) -> DataFrame:
    """(idx, text) of every column, ignored ones included."""
    rows = [(c.index, S.column_text(t.name, c.name, c.description)) for t, c in annotation.column_list()]
    return spark.createDataFrame(rows, "idx long, text string")


def categorical(db: RawDatabase) -> DataFrame:
    """(column_idx, category, text, idx): categories of every categorical column.

    A string that columns of one name share has one number; so a column's numbers need not follow each other, and its
    first is the number of its first category.
    """
    parts = None
    for t, c in db.annotation.column_list():
        if c.stype == SType.CATEGORICAL and c.name in db.scan(t.name).columns:
            values = db.scan(t.name).select(S.as_text(F.col(f"`{c.name}`")).alias("category")).filter("category is not null").distinct()
            part = values.select(F.lit(c.index).alias("column_idx"), "category", S.category_text(c.name, F.col("category")).alias("text"))
            parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return db.spark.createDataFrame([], "column_idx int, category string, text string, idx long")
    first = parts.groupBy("text").agg(F.min(F.struct("column_idx", "category")).alias("at"))
    index = numbered(first.select("text", "at.column_idx", "at.category"), ["column_idx", "category"]).select("text", "idx")
    return parts.join(index, "text").select("column_idx", "category", "text", "idx")


def texts(db: RawDatabase) -> DataFrame:
    """(text, idx): distinct texts, cut to their most bytes, in the order of table, column and row."""
    parts = None
    for t, c in db.annotation.column_list():
        if c.stype == SType.TEXT and c.name in db.scan(t.name).columns:
            part = db.rows(t.name).select(F.lit(c.index).alias("column_idx"), "row_id", S.truncated(S.as_text(F.col(f"`{c.name}`"))).alias("text")).filter("text is not null")
            parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return db.spark.createDataFrame([], "text string, idx long")
    first = parts.groupBy("text").agg(F.min(F.struct("column_idx", "row_id")).alias("at"))
    return numbered(first.select("text", "at.column_idx", "at.row_id"), ["column_idx", "row_id"]).select("text", "idx")


def all_strings(spark: SparkSession, annotation: Annotation, categories: DataFrame, text: DataFrame) -> DataFrame:
    """(kind, idx, text) of the three vocabularies, to be embedded in one pass."""
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), "idx", "text")
    return kind("column", column_texts(spark, annotation)).unionByName(kind("categorical", categories.select("idx", "text").distinct())).unionByName(kind("text", text))
